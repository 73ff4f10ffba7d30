"""Ids of a tokenizer file, with a bounded table of the chunks met so far."""

from __future__ import annotations

import os

import numpy as np

from .words import blocks, bounds, bytes_of, hashes, padded

_PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def encoder(path: str) -> "Encoder":
    """The worker's own encoder for path: one per process, so that its table serves all tasks of a stage."""
    from .common import worker_cache

    kept = worker_cache("tokens")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class Encoder:
    """Same ids as Tokenizer.encode(text, add_special_tokens=False), for tokenizers that drop white space.

    White space never joins two chunks there, so texts are cut at it and each chunk is encoded once. A hash table of
    arrays holds up to most_kept chunks by a 64-bit hash of their bytes: place and length of their ids in one pool, and of the
    bytes themselves in another; a chunk of other bytes with the same hash is encoded by itself. A full table is emptied. If the tokenizer lower-cases and parts letters from punctuation, which is tried once, "Word,"
    is put together from "word" and ","; chunks of small letters are then joined by blanks and encoded by the model without
    its normaliser, and parted where its word ends are.
    """

    def __init__(self, path: str, most_kept: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most_kept = Tokenizer.from_file(path), most_kept
        self.slim = Tokenizer.from_file(path)
        self.slim.normalizer = None
        self.slim.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.is_end[i] = bool(suffix) and token.endswith(suffix)
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        tried = ("word", "zażeïr", "q", "thenouiti", "straße")
        self.parts = all(plain(a.upper() if a[-1] != "e" else a.title()) == plain(a) for a in tried) and all(plain(a + t) == plain(a) + plain(t) for a in tried for t in (",", "...", "###"))
        self.parts = self.parts and self.slim.encode(" ".join(tried)).ids == plain(" ".join(tried)) and int(self.is_end[plain(" ".join(tried))].sum()) == len(tried)
        self._empty(1 << 12)

    def _empty(self, slots: int) -> None:
        self._clear(slots)
        self.pool, self.pooled = np.zeros(1 << 14, np.uint32), 0
        self.bytes, self.byte_count = np.zeros(1 << 16, np.uint8), 0

    def _clear(self, slots: int) -> None:
        self.bits, self.held = slots.bit_length() - 1, 0
        self.keys = np.zeros(slots, np.uint64)
        #: of each slot: place and count of ids, place and length of the chunk's bytes
        self.entries = [np.zeros(slots, t) for t in (np.int64, np.int32, np.int64, np.int32)]

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or that of the free place where it would go, as -1 - slot."""
        mask = len(self.keys) - 1
        at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found, open_ = np.empty(len(h), np.int64), np.arange(len(h))
        while len(open_):
            here = self.keys[at]
            hit, free = here == h[open_], here == 0
            found[open_] = np.where(free, -1 - at, at)
            rest = ~(hit | free)
            open_, at = open_[rest], (at[rest] + 1) & mask
        return found

    def _insert(self, h: np.ndarray, *entries: np.ndarray) -> None:
        """Puts distinct new hashes into the table; several that want one free slot take turns."""
        if 2 * (self.held + len(h)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            old = self.keys[used], *(e[used] for e in self.entries)
            self._clear(1 << (2 * (self.held + len(h))).bit_length())
            self._insert(*old)
        self.held += len(h)
        while len(h):
            at = -1 - self._slots(h)
            won = np.unique(at, return_index=True)[1]
            self.keys[at[won]] = h[won]
            for held, new in zip(self.entries, entries):
                held[at[won]] = new[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            h, entries = h[lost], [e[lost] for e in entries]

    def _add(self, h: np.ndarray, chunks: list[str], place: np.ndarray, count: np.ndarray) -> None:
        """Puts distinct new chunks with the hashes h and their ids into the table."""
        raw = [c.encode() for c in chunks]
        lengths = np.array([len(r) for r in raw])
        at, n = self.byte_count, int(lengths.sum())
        self.byte_count += n
        if self.byte_count + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes[:at], np.zeros(max(len(self.bytes), n + 8), np.uint8)])
        self.bytes[at : at + n] = np.frombuffer(b"".join(raw), np.uint8)
        self._insert(h, place, count, at + np.cumsum(lengths) - lengths, lengths)

    def _ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of the words of raw whose hashes are in slots; words of other bytes than the slot's chunk are encoded now."""
        place, count, at, length = (e[slots] for e in self.entries)
        count, wanted = count.astype(np.int64), ends - starts
        same = length == wanted
        some, j = np.flatnonzero(same), 0
        while len(some):
            left = wanted[some] - j
            apart = blocks(raw, starts[some] + j, left) != blocks(self.bytes, at[some] + j, left)
            same[some[apart]] = False
            j += 8
            some = some[~apart & (left > 8)]
        other = np.flatnonzero(~same)
        if len(other):
            place[other], count[other] = self._learn_whole([raw[a:b].tobytes().decode() for a, b in zip(starts[other].tolist(), ends[other].tolist())])
        return place, count

    def _store(self, ids: np.ndarray) -> int:
        """Place of ids at the end of the pool."""
        at, self.pooled = self.pooled, self.pooled + len(ids)
        if self.pooled > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : self.pooled] = ids
        return at

    def _learn_whole(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of chunks encoded by the whole tokenizer: offsets tell which ids belong to which chunk."""
        places, counts = [], []
        for i in range(0, len(chunks), 4000):
            part = chunks[i : i + 4000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(c) + 1 for c in part)])
            at = np.searchsorted(starts, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.offsets)), "right") - 1
            ends = np.searchsorted(at, np.arange(len(part)), "right")
            begins = np.concatenate([[0], ends[:-1]])
            places.append(self._store(np.array(got.ids, np.uint32)) + begins)
            counts.append(ends - begins)
        return np.concatenate(places), np.concatenate(counts)

    def _learn_plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of words of small letters: each ends at an id that ends a word."""
        places, counts = [], []
        for i in range(0, len(chunks), 4000):
            part = chunks[i : i + 4000]
            ids = np.array(self.slim.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):
                place, count = self._learn_whole(part)
            else:
                begins = np.concatenate([[0], ends[:-1]])
                place, count = self._store(ids) + begins, ends - begins
            places.append(place)
            counts.append(count)
        return np.concatenate(places), np.concatenate(counts)

    def _learn(self, h: np.ndarray, chunks: list[str]) -> None:
        """Puts distinct new chunks with the hashes h into the table."""
        plain, made, whole, cores, tails = [], [], [], [], []
        for i, c in enumerate(chunks):
            core = c.rstrip(_PUNCTUATION)
            # below U+0130 lower() is the tokenizer's own mapping, letter by letter
            if not self.parts or not core.isalpha() or max(core) >= "İ":
                whole.append(i)
                continue
            small = core.lower()
            if small == c:
                plain.append(i)
            else:
                made.append(i)
                cores.append(small)
                tails.append(c[len(core) :])
        for some, learn in ((whole, self._learn_whole), (plain, self._learn_plain)):
            if some:
                some_chunks = [chunks[i] for i in some]
                self._add(h[some], some_chunks, *learn(some_chunks))
        if made:
            place, count = self._entries_of(cores)
            bare = np.array([not t for t in tails])
            rest = sorted({t for t in tails if t})
            if rest:
                t_place, t_count = self._entries_of(rest)
                ids = {t: self.pool[p : p + n].copy() for t, p, n in zip(rest, t_place.tolist(), t_count.tolist())}
                joined, lengths = [], []
                for p, n, t in zip(place[~bare].tolist(), count[~bare].tolist(), (t for t in tails if t)):
                    joined += [self.pool[p : p + n], ids[t]]
                    lengths.append(n + len(ids[t]))
                lengths = np.array(lengths)
                place[~bare], count[~bare] = self._store(np.concatenate(joined)) + np.cumsum(lengths) - lengths, lengths
            self._add(h[made], [chunks[i] for i in made], place, count)

    def _entries_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of chunks without white space, learned if they are new."""
        data = np.frombuffer("\n".join(chunks).encode(), np.uint8)
        starts, ends, _ = bounds(data, np.array([0, len(data)]))
        h = hashes(data, starts, ends)
        h[h == 0] = 1
        slots = self._slots(h)
        new = np.flatnonzero(slots < 0)
        if len(new):
            distinct, where = np.unique(h[new], return_index=True)
            chosen = [chunks[i] for i in new[where].tolist()]
            learn = self._learn_whole if chosen[0][-1] in _PUNCTUATION else self._learn_plain
            self._add(distinct, chosen, *learn(chosen))
            slots = self._slots(h)
        return self._ids(padded(data), starts, ends, slots)

    def encode(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts of an Arrow string column in turn, end_id after each text if given, and their ends.

        A null text has no ids of its own. Hold slices of about a megabyte at once.
        """
        data, offsets = bytes_of(column)
        starts, ends, first = bounds(data, offsets)
        h = hashes(data, starts, ends)
        h[h == 0] = 1
        slots = self._slots(h)
        new = np.flatnonzero(slots < 0)
        if len(new):
            distinct, where = np.unique(h[new], return_index=True)
            if self.held + 2 * len(distinct) > self.most_kept:
                self._empty(1 << 12)
                distinct, where = np.unique(h, return_index=True)
                new = np.arange(len(h))
            at = new[where]
            raw = data.tobytes()
            self._learn(distinct, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            slots = self._slots(h)
        place, n = self._ids(padded(data), starts, ends, slots)
        before = np.concatenate([[0], np.cumsum(n)])
        texts = len(offsets) - 1
        extra = 0 if end_id is None else 1
        # the place in the output of each word, each text before it adding its end
        word_at = before[:-1] + extra * np.repeat(np.arange(texts), np.diff(first))
        out = np.full(before[-1] + extra * texts, end_id or 0, np.uint32)
        shift = np.repeat(word_at - place, n)
        to = np.arange(before[-1]) + extra * np.repeat(np.repeat(np.arange(texts), np.diff(first)), n)
        out[to] = self.pool[to - shift]
        return out, before[first[1:]] + extra * np.arange(1, texts + 1)


def batches(texts: list, most_chars: int = 2_000_000):
    """Slices of texts of about most_chars each: bounds what one call holds."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= most_chars:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
