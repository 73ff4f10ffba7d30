"""Words of whole Arrow text columns and their hashes, by array operations instead of string objects."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words hashed at once; longer words than _LONG bytes are hashed one by one.
_AT_ONCE, _LONG = 1 << 14, 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The initial state of SipHash.
_STATE = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
#: For k bytes left of a word, those of a block of 8 that are its own.
_OWN = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null text has no bytes."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def slices(column, most_bytes: int = 1 << 20):
    """(begin, end) of runs of rows with about most_bytes of text each: bounds what is held at once."""
    _, at = bytes_of(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most_bytes, "right")) - 1)
        yield begin, end
        begin = end


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' places in data, and the number of words before each text (one entry more)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner], ends[inner - 1] = solid[inner], solid[inner - 1]
    begins = np.flatnonzero(begins)
    return begins, np.flatnonzero(ends) + 1, np.searchsorted(begins, offsets)


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(v: list[np.ndarray]) -> None:
    v[0] += v[1]
    v[2] += v[3]
    v[1] = _turned(v[1], 13) ^ v[0]
    v[3] = _turned(v[3], 16) ^ v[2]
    v[0] = _turned(v[0], 32) + v[3]
    v[2] += v[1]
    v[1] = _turned(v[1], 17) ^ v[2]
    v[3] = _turned(v[3], 21) ^ v[0]
    v[2] = _turned(v[2], 32)


def blocks(raw: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes of raw from each place on as a number, only `left` of them where fewer are left; raw has 8 bytes more than its words."""
    eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))[at].view(np.uint64).ravel()
    return eight & _OWN[np.minimum(left, 8)]


def _mixed(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SipHash with one round a block and three at the end, of words of _LONG bytes at most."""
    v = [np.full(len(starts), x, np.uint64) for x in _STATE]
    v[0] ^= lengths.astype(np.uint64)
    whole = v
    some = np.arange(len(starts))
    for j in range(0, int(lengths.max(initial=0)), 8):
        if j:
            more = np.flatnonzero(lengths[some] > j)
            some = some[more]
            v = [x[some] for x in whole]
        m = blocks(raw, starts[some] + j, lengths[some] - j)
        v[3] ^= m
        _round(v)
        v[0] ^= m
        if j:
            for x, y in zip(whole, v):
                x[some] = y
        else:
            whole = v
    v = whole
    v[2] ^= np.uint64(0xFF)
    for _ in range(3):
        _round(v)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def padded(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """data with 8 zeros after it, for blocks(); with lower, A-Z are those of a-z."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = _LOWER[data] if lower else data
    return raw


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: every block of 8 bytes is mixed in without a linear law that texts could be built on.

    Words that share a hash without being equal are as rare as for a random function: some 2**32 words must be tried to find two.
    """
    out, raw, lengths = np.empty(len(starts), np.uint64), padded(data, lower), ends - starts
    for i in range(0, len(starts), _AT_ONCE):
        k = i + _AT_ONCE
        out[i:k] = _mixed(raw, starts[i:k], np.minimum(lengths[i:k], _LONG))
    for i in np.flatnonzero(lengths > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_hashes(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all words of a column; text i has those from first[i] to first[i + 1]."""
    data, offsets = bytes_of(column)
    starts, ends, first = bounds(data, offsets)
    return hashes(data, starts, ends, lower), first
