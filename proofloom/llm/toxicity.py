"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of an n-gram is one feature; its value is the log ratio r of its smoothed shares among
toxic and clean training texts, made smaller by how little the texts that have it say: by a power of
|r| * sqrt(texts with it), as far as that is below EVIDENCE. Logistic regression over the scaled features, fitted by dual coordinate
descent until the duality gap is closed, gives the weights. N-grams are hashed into 2**BITS cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import discard, release, written

BITS, ORDERS = 20, (4, 5, 6)
#: Fit: at most so many labelled rows of each class, those with the smallest hashes of their ids.
MOST_PER_CLASS = 3000
#: And so many distinct n-grams in all of them together: rows later in that order are left out.
MOST_CELLS = 1 << 25
#: |r| * sqrt(texts) from which a ratio counts in full, and the power by which smaller ones are made smaller; below LEAST they are 0.
EVIDENCE, POWER, LEAST = 8.0, 8, 1e-3
#: Penalty on the squared weights, against the sum of the losses.
L2 = 1.0
#: The fit ends at this duality gap, relative to the loss. Some tens of rounds do; a fit of so many would return what it has.
GAP, MOST_ROUNDS = 1e-4, 1000
#: Value of the feature that all texts have; its weight is the intercept.
_ALWAYS = 3.0
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell) of every character n-gram; texts are lower-cased, white space runs are one blank."""
    lowered = [" " + " ".join((t or "").lower().split()) + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in lowered])
    doc = np.repeat(np.arange(len(texts)), lengths)
    docs, out, h = [], [], codes.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[:-1] * _PRIME + codes[n - 1 :]
        if n in ORDERS:
            inside = doc[: len(h)] == doc[n - 1 :]
            mixed = (h ^ (h >> np.uint64(29))) * _PRIME
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64)[inside])
            docs.append(doc[: len(h)][inside])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(out)


@dataclass
class Model:
    """weights: of every cell, 0 for those that no training text has."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], most_chars: int = 200_000) -> np.ndarray:
        from .tokens import batches

        parts = []
        for s in batches(texts, most_chars):
            doc, cell = cells(texts[s])
            hit = self.weights[cell] != 0
            seen = np.unique(doc[hit] * (1 << BITS) + cell[hit])
            z = self.bias + np.bincount(seen >> BITS, self.weights[seen & ((1 << BITS) - 1)], len(texts[s]))
            parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(parts) if parts else np.zeros(0)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_per_class: int = MOST_PER_CLASS) -> Model:
    """Learns from labelled rows that are not held out; rows without text or label teach nothing.

    The two classes are sampled apart (most_per_class rows each at most, by hash of the id) and the
    intercept is set back by the rates of the samples: scores are odds among all training labels, whether
    the bound is reached or not. Without rows of both classes every score is the share of toxic rows among the labels (0 without
    labels). The driver holds the cells of the sample: MOST_CELLS numbers at most.
    """
    known = labels.where("toxic IS NOT NULL").groupBy(key).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col(key))).join(docs.where(F.col(text).isNotNull()).select(key).distinct(), key, "left_semi")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64(key), key).limit(most_per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).where(F.col(text).isNotNull())

    def distinct(parts):
        import pyarrow as pa

        release()
        for batch in parts:
            ids, texts, y = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for i in range(len(texts)):
                out.append(np.unique(cells(texts[i : i + 1])[1]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(y, pa.int32())], ["key", "cells", "toxic"])

    found = written(rows.select(F.col(key).cast("long"), text, F.col("toxic").cast("int")).mapInArrow(distinct, "key long, cells binary, toxic int"), "toxic-cells")
    sizes = found.select("key", "toxic", F.xxhash64("key").alias("h"), (F.octet_length("cells") / 4).cast("long").alias("n")).orderBy("h", "key").toArrow().to_pandas()  # a row for each sampled text
    over = sizes["h"][sizes["n"].cumsum() > MOST_CELLS]
    within = sizes["h"] < over.iloc[0] if len(over) else sizes["h"].notna()
    drawn, used = ({label: int((some["toxic"] == label).sum()) for label in (0, 1)} for some in (sizes, sizes[within]))
    rows = found.where(F.xxhash64("key") < int(over.iloc[0])) if len(over) else found

    def counted(parts):
        import pyarrow as pa

        n = np.zeros((2, 1 << BITS), np.int64)
        for batch in parts:
            for data, y in zip(batch.column("cells").to_pylist(), batch.column("toxic").to_pylist()):
                n[y][np.frombuffer(data, np.int32)] += 1
        some = np.flatnonzero((n[0] + n[1]) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0][some]), pa.array(n[1][some])], ["cell", "clean", "toxic"])

    per_cell = rows.mapInArrow(counted, "cell long, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = used[0], used[1]
    if not n0 or not n1:
        discard(found)
        return Model(np.zeros(1 << BITS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    seen = per_cell.toArrow()  # 2**BITS cells at most
    clean, toxic = (seen.column(c).to_numpy() for c in ("clean", "toxic"))
    scale = np.zeros(1 << BITS)
    scale[seen.column("cell").to_numpy()] = scaled(clean, toxic, n0, n1)
    some = scale != 0

    def reduced(parts):
        import pyarrow as pa

        for batch in parts:
            out = [(c := np.frombuffer(data, np.int32))[some[c]].tobytes() for data in batch.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary()), batch.column("toxic")], ["key", "cells", "toxic"])

    sample = rows.mapInArrow(reduced, "key long, cells binary, toxic int").orderBy("key", "cells").toArrow()
    w, b = regress([np.frombuffer(x, np.int32) for x in sample.column("cells").to_pylist()], scale, sample.column("toxic").to_numpy() == 1)
    discard(found)
    rate = [used[label] / drawn[label] * min(1.0, most_per_class / counts[label]) for label in (0, 1)]
    return Model(w, float(b + np.log(rate[0]) - np.log(rate[1])))


def scaled(clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Values of the features that clean and toxic of n0 and n1 texts have: log-count ratios, less for little evidence."""
    r = np.log(((toxic + 1) / (n1 + 2)) / ((clean + 1) / (n0 + 2)))
    value = r * np.minimum(1.0, np.abs(r) * np.sqrt(clean + toxic) / EVIDENCE) ** POWER
    return np.where(np.abs(value) >= LEAST, value, 0.0)


def regress(texts: list[np.ndarray], scale: np.ndarray, toxic: np.ndarray, l2: float = L2, gap: float = GAP) -> tuple[np.ndarray, float]:
    """(weight of every cell in a text's score, intercept) of the logistic regression over the scaled cells of each text.

    Dual coordinate descent: a round solves for each text's multiplier in turn, in random order, the others held.
    """
    n, most = len(texts), 1 / l2
    square, sign = scale**2, np.where(toxic, 1.0, -1.0)
    norms = np.array([square[t].sum() for t in texts]) + _ALWAYS**2
    alpha, w, b = np.full(n, 1e-6 * most), np.zeros(len(scale)), 0.0
    for t, s, a in zip(texts, sign, alpha):
        w[t] += s * a * square[t]
        b += s * a * _ALWAYS**2
    order, used = np.random.default_rng(0), square > 0
    for _ in range(MOST_ROUNDS):
        for i in order.permutation(n).tolist():
            t, before = texts[i], float(alpha[i])
            now = _multiplier(sign[i] * (w[t].sum() + b), norms[i], before, most)
            if now != before:
                alpha[i] = now
                w[t] += sign[i] * (now - before) * square[t]
                b += sign[i] * (now - before) * _ALWAYS**2
        z = np.array([w[t].sum() for t in texts]) + b
        penalty = l2 / 2 * ((w[used] ** 2 / square[used]).sum() + b**2 / _ALWAYS**2)
        primal = np.logaddexp(0, -sign * z).sum() + penalty
        dual = -penalty - l2 * (alpha * np.log(alpha / most) + (most - alpha) * np.log(1 - alpha / most)).sum()
        if primal - dual <= gap * primal:
            break
    return w, b


def _multiplier(margin: float, norm: float, before: float, most: float) -> float:
    """The a in (0, most) with margin + norm * (a - before) + log(a / (most - a)) = 0: Newton steps on the log odds, kept in a shrinking range."""
    low, high, a = 1e-12 * most, most * (1 - 1e-12), before
    odds = math.log(a / (most - a))
    for _ in range(60):
        g = margin + norm * (a - before) + odds
        if abs(g) < 1e-10:
            break
        low, high = (low, a) if g > 0 else (a, high)
        odds -= g / (1 + norm * a * (most - a) / most)
        a = most / (1 + math.exp(-odds)) if odds > -700 else low
        if not low < a < high:
            a = (low + high) / 2
            odds = math.log(a / (most - a))
    return a


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with name (0 to 1, higher: toxic likelier); null and empty texts get the score of no features.

    A column of that name in docs is replaced; equal rows are scored apart; all of a text counts, however long.
    """
    docs = docs.drop(name)
    names, schema = docs.columns, docs.schema

    def run(parts):
        import pyarrow as pa

        release()
        for batch in parts:
            got = model.scores(batch.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*names, name])

    return docs.mapInArrow(run, StructType([*schema.fields]).add(name, DoubleType()))
