"""Embedding whitening: exact sums, a Gramian of centred rows by MLlib's RowMatrix, a local eigendecomposition.

Entries become whole numbers x, so sums are exact and centring loses nothing: n*x - S is computed in whole numbers and
rounded once, when it is divided by n. Only the d sums and the d by d Gramian come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, written

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond count as this much: whole numbers up to it are exact as doubles.
MOST = 1 << 52
#: Components whose variance is below this share of the largest have none but rounding's.
LEAST_SHARE = 1e-13


@dataclass
class Space:
    """What is fitted: n vectors with per-dimension sums of x, the components (a row each, by falling eigenvalue)."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def _finite(vector: Column) -> Column:
    entry = lambda e: e.isNotNull() & (F.abs(e.cast("double")) < F.lit(float("inf")))  # noqa: E731  (NaN is above infinity in Spark)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)


def _whole(block: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * block), -MOST, MOST).astype(np.int64) + SHIFT


def _blocks(batch, at: int):
    """(rows, x) of an Arrow batch for each length of its vectors: the rows' places and their entries as whole numbers."""
    column = batch.column(at)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        values = column.take(rows).flatten().to_numpy(zero_copy_only=False).astype(float)
        yield rows, _whole(values.reshape(len(rows), size))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n*x - S as doubles, sum of its squares exactly); whole numbers of any size where 64 bits might not do."""
    centre = np.array(sums, object)
    reach = float(n) * np.abs(x).max(initial=0) + max(abs(s) for s in sums)
    if reach < 2.0**62:
        centred = n * x - centre.astype(np.int64)
        if np.square(centred.astype(float)).sum(axis=1).max(initial=0) < 2.0**62:
            return centred.astype(float), np.square(centred).sum(axis=1)
        return centred.astype(float), np.square(centred.astype(object)).sum(axis=1)
    centred = n * x.astype(object) - centre
    return centred.astype(float), np.square(centred).sum(axis=1)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, per-dimension sums of x) over rows (vector), of the vectors with the most frequent length (the longer of two)."""

    def summed(parts):
        import pyarrow as pa

        kept = {}
        for batch in parts:
            for _, x in _blocks(batch, 0):
                n, s = kept.get(x.shape[1], (0, 0))
                # 2**26 * high + low, so that a batch's sums fit 64 bits
                kept[x.shape[1]] = n + len(x), s + (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        for size, (n, s) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(v) for v in s])], ["size", "at", "n", "s"])

    parts = rows.mapInArrow(summed, "size int, at int, n long, s string")
    sums = written(parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    size = sums.where("at = 0").orderBy(F.desc("n"), F.desc("size")).select("size", "n").first()
    if size is None:
        discard(sums)
        return 0, []
    found = sums.where(F.col("size") == size[0]).orderBy("at").collect()  # a row for each dimension
    discard(sums)
    return size[1], [int(r["s"]) for r in found]


def covariance(rows: DataFrame, n: int) -> np.ndarray:
    """Gramian of rows (v: array of centred doubles), divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def fit(rows: DataFrame, most: int) -> Space | None:
    """The space of rows (vector): at most `most` components, without those that have no variance; None where there are none."""
    n, sums = totals(rows)
    if not n:
        return None

    def centred(parts):
        import pyarrow as pa

        release()
        for batch in parts:
            for _, x in _blocks(batch, 0):
                if x.shape[1] == len(sums):
                    v = _deviations(x, n, sums)[0] / n
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel())], ["v"])

    v = covariance(rows.mapInArrow(centred, "v array<double>"), n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = int((values[:most] > LEAST_SHARE * max(values[0], 0.0)).sum())
    if not k:
        return None
    vectors = vectors[:k] * np.sign(vectors[np.arange(k), np.abs(vectors[:k]).argmax(axis=1)])[:, None]
    return Space(n, sums, vectors, values[:k], values[:k] / np.trace(v))


def project(rows: DataFrame, space: Space) -> DataFrame:
    """(key, deviation, whitened) of rows (key, vector) as a table; whitened is an array with an entry for each component."""
    spark = rows.sparkSession
    given = spark.sparkContext.broadcast((space.n, space.sums, space.components, space.eigenvalues))

    def whiten(parts):
        import pandas as pd

        n, sums, components, eigenvalues = given.value
        for frame in parts:
            frame = frame[frame["vector"].map(len) == len(sums)]
            if len(frame):
                centred, squares = _deviations(_whole(np.stack(frame["vector"].to_numpy()).astype(float)), n, sums)
                out = (centred / n) @ components.T / np.sqrt(eigenvalues)
                yield pd.DataFrame({"key": frame["key"], "deviation": [str(s) for s in squares], "whitened": list(out)})

    # ids and exact sums travel as text: pandas has no whole numbers with nulls
    made = rows.select(F.col("key").cast("string").alias("key"), "vector").mapInPandas(whiten, "key string, deviation string, whitened array<double>")
    return written(made.select(F.col("key").cast("long").alias("key"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened"), "whitened")


def identity_error(table: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of (covariance of whitened - identity), over all rows of the table."""
    means = table.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k))).first()
    centred = table.select(F.array(*(F.col("whitened")[i] - F.lit(means[i]) for i in range(k))).alias("v"))
    return float(np.abs(covariance(centred, n) - np.eye(k)).max())


def whitened(rows: DataFrame, key: str, vector: str, most: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to `most`.

    key is an integer id; other columns are not read. Vectors that are null, empty or hold null or non-finite entries are
    dropped, and so are those whose length isn't the most frequent one (the longer of two as frequent), which lie in no common
    space. Null ids stay, repeated rows are each fitted and returned. Components are numbered by falling
    eigenvalue; each has its largest entry (by absolute value) positive. Components without variance (fewer vectors than dimensions,
    constant entries) have no rows: vectors that are all equal, and empty tables, give no rows. deviation is exact as
    decimal(38,0).
    """
    spark = rows.sparkSession
    names = "key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    kept = rows.where(_finite(F.col(vector))).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    space = fit(kept.select("vector"), most)
    if space is None:
        return spark.createDataFrame([], names)
    table = project(kept, space)
    error = identity_error(table, space.n, len(space.eigenvalues))
    each = table.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(e)) for e in space.explained)), F.col("at") + 1)
    return each.select("key", (F.col("at") + 1).alias("component"), F.lit(space.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
