"""Repeated passages by sparse suffixes: only suffixes at content-selected minimiser positions are kept.

Every window of `passage` words has a minimiser: the position of the smallest hash of `gram`
words in it. Equal windows have their minimisers at equal places, so a passage that repeats is
met at a kept suffix of each copy. Suffixes whose first `gram` words are unique are dropped. The
others are extended left and right to the windows whose minimiser they are; these are sorted by a
hash of the whole window, equal neighbours are matches, and windows that touch join into one span.
Sorting whole suffixes would hold all suffixes of a common prefix in one task; hashes of windows
of fixed length give the same matches of `passage` words or more and keep counts mergeable.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, free_name, release, written
from .words import slices, word_hashes

_PRIME = np.uint64(0x9E3779B97F4A7C15)
PASSAGE, GRAM = 50, 20
_WORD = re.compile(WORD)


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words, by doubling: log k passes."""
    out, have, power = None, 0, ids
    size = 1
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                if out is None:
                    out, have = power.copy(), size
                else:
                    n = len(ids) - have - size + 1
                    out = (out[:n] * _PRIME) ^ (power[have : have + n] + (out[:n] >> np.uint64(31)))
                    have += size
            k >>= 1
            if k:
                n = len(power) - size
                power = (power[:n] * _PRIME) ^ (power[size : size + n] + (power[:n] >> np.uint64(31)))
                power = power * _PRIME
                size *= 2
        out = (out ^ (out >> np.uint64(32))) * _PRIME
    return out ^ (out >> np.uint64(29))


def _minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of width grams, the position of its smallest hash, the first of equal ones."""
    at, size, n = np.arange(len(grams)), 1, len(grams) - width + 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        size += step
    return at[:n]


def repeated_spans(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, first, last, kept): spans of words that repeat in `passage` words or more.

    first and last (excluded) count words of the text, mark is its hash. kept: the span is covered by first occurrences (by
    ascending doc_id, then place) of windows; spans are cut where this changes, so the spans not kept are
    what dedup removes. Of equal texts only that of the smallest id is searched; the others are one span, not kept. Rows that
    are equal in id and text count as one row, rows with equal ids as parts of one document, of which
    each keeps what occurs there first. Null, empty and shorter texts have no spans.
    """
    width = passage - gram + 1
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))

    def sampled(parts):
        import pyarrow as pa

        release()
        for batch in parts:
            for a, b in slices(batch.column(1)):
                every, first = word_hashes(batch.column(1)[a:b])
                counts, grams, rows = np.diff(first), [], np.flatnonzero(np.diff(first) >= passage)
                for i in rows.tolist():
                    g = _hashes(every[first[i] : first[i + 1]], gram)
                    grams.append(g[np.unique(_minimisers(g, width))])
                if not grams:
                    continue
                kept = np.array([len(g) for g in grams])
                of, sizes = pa.array(np.repeat(rows, kept)), np.zeros(kept.sum(), np.int64)
                sizes[np.cumsum(kept) - kept] = counts[rows]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(of), batch.column(2)[a:b].take(of), pa.array(np.concatenate(grams).view(np.int64)), pa.array(sizes)], ["doc_id", "mark", "gram", "words"])

    # one row per kept suffix; words is set on the first of a row alone
    suffixes = written(base.mapInArrow(sampled, "doc_id long, mark long, gram long, words long"), "suffixes")
    heads = suffixes.where("words > 0").select("doc_id", "mark", "words")
    units = written(heads.groupBy("mark").agg(F.min("doc_id").alias("unit"), F.count(F.lit(1)).alias("times")), "units")
    # written out, so that the join's own shuffle is split where a gram is hot
    often = written(suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
    hot = suffixes.join(often, "gram", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("gram").alias("grams"))
    hot = written(hot.join(units, "mark").where("doc_id <=> unit").select("doc_id", "mark", "grams", "times"), "hot-suffixes")

    def extended(parts):
        import pyarrow as pa

        release()
        for batch in parts:
            for a, b in slices(batch.column(1)):
                every, first = word_hashes(batch.column(1)[a:b])
                of, places, found, again = [], [], [], []
                for i in range(b - a):
                    words = every[first[i] : first[i + 1]]
                    g = _hashes(words, gram)
                    at = g.view(np.int64)[_minimisers(g, width)]
                    some = np.flatnonzero(np.isin(at, np.array(batch.column(3)[a + i].as_py(), np.int64)))
                    window = _hashes(words, passage)[some]
                    twice = np.ones(len(some), bool)
                    twice[np.unique(window, return_index=True)[1]] = False
                    of.append(np.full(len(some), i))
                    places.append(some.astype(np.int32))
                    found.append(window)
                    again.append(twice)
                of = pa.array(np.concatenate(of))
                d, m, times = (batch.column(c)[a:b].take(of) for c in (0, 2, 4))
                yield pa.RecordBatch.from_arrays([d, m, pa.array(np.concatenate(places)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(again)), times], ["doc_id", "mark", "at", "window", "again", "times"])

    left, right = base.alias("l"), hot.alias("r")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))).select("l.doc_id", "l.text", "l.mark", "r.grams", "r.times")
    windows = written(joined.mapInArrow(extended, "doc_id long, mark long, at int, window long, again boolean, times long"), "windows")
    groups = written(windows.groupBy("window").agg(F.sum("times").alias("n"), F.min("doc_id").alias("head")).where("n > 1").select("window", "head"), "groups")
    met = windows.select("doc_id", "mark", "at", "window", "again").join(groups, "window").select("doc_id", "mark", "at", (F.col("head").eqNullSafe(F.col("doc_id")) & ~F.col("again")).alias("first"))
    per_doc = met.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.when(F.col("first"), F.col("at")))).alias("firsts"), F.sort_array(F.collect_set("at")).alias("all"))

    def joined_spans(parts):
        import pyarrow as pa

        for batch in parts:
            out = []
            for d, m, firsts, every in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "firsts", "all"))):
                n = every[-1] + passage

                def covered(starts):
                    at = np.array(starts, np.int64)
                    return (np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + passage, minlength=n + 1)) > 0)[:n]

                state = covered(every).astype(int) + covered(firsts)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(state)) + 1, [n]])
                out += [(d, m, int(a), int(b), bool(state[a] == 2)) for a, b in zip(cuts[:-1], cuts[1:]) if state[a]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["doc_id", "mark", "first", "last", "kept"])

    spans = per_doc.mapInArrow(joined_spans, "doc_id long, mark long, first long, last long, kept boolean")
    copies = heads.join(units.select("mark", "unit"), "mark").where("NOT doc_id <=> unit").distinct()
    return spans.unionByName(copies.select("doc_id", "mark", F.lit(0).cast("long").alias("first"), F.col("words").alias("last"), F.lit(False).alias("kept")))


def without_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """docs with every repeated passage but its first occurrence cut out of the text.

    The text between the remaining words stays as it is; a text that is all repeats goes to its empty rest and its row
    is dropped. n_chars is set anew if it is there. Rows without repeats pass unchanged.
    """
    names = docs.columns
    spans = repeated_spans(docs, passage, gram).where("NOT kept").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_cuts"))
    spans = written(spans, "cuts")
    rows, cuts = docs.alias("l"), spans.alias("r")
    joined = rows.join(cuts, F.col("l.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("l.text") == F.col("r.mark")), "left")
    joined = joined.select(*[F.col(f"l.`{c}`") for c in names], F.col("r._cuts").alias(free_name(names, "cuts")))

    def cut(parts):
        import pyarrow as pa

        release()
        for batch in parts:
            texts = batch.column(names.index("text")).to_pylist()
            cuts = batch.column(len(names)).to_pylist()
            for i, spans_of in enumerate(cuts):
                if not spans_of:
                    continue
                at = [m.span() for m in _WORD.finditer(texts[i])]
                kept, begin = [], 0
                for s in spans_of:
                    kept.append(texts[i][begin : at[s["first"]][0]])
                    begin = at[s["last"] - 1][1]
                texts[i] = "".join([*kept, texts[i][begin:]]).strip()
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(j) for j, n in enumerate(names)]
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            keep = pa.array([not c or t != "" for t, c in zip(texts, cuts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return joined.mapInArrow(cut, docs.schema)
