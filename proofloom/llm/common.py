"""What the operators share: worker caches, two-level running sums, the package for the workers."""

from __future__ import annotations

import math
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import components, discard, fresh_path, shared_dir, written

__all__ = ["components", "discard", "fresh_path", "shared_dir", "written"]

#: White space and words of the contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Caches of a Python worker by kind; a worker that turns to another kind drops those of the one before.
_CACHES: dict[str, dict] = {}


def worker_cache(kind: str) -> dict:
    """The worker's cache of a kind. Workers outlive stages, so what other kinds have kept is given back first."""
    if kind not in _CACHES:
        release()
        _CACHES[kind] = {}
    return _CACHES[kind]


def release() -> None:
    """Gives the worker's caches and freed memory back: to be called where a stage of Python workers begins."""
    import ctypes
    import gc

    _CACHES.clear()
    gc.collect()
    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable instead of an inlined expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores put before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_bits(n: int, per_bucket: int = 512) -> int:
    """log2 of the number of hash buckets that hold per_bucket rows each."""
    return max(0, math.ceil(math.log2(max(1, n) / per_bucket))) if n > per_bucket else 0


def hash_bucket(hashed: Column, bits: int) -> Column:
    """The top bits of a hash as a number that rises with the hash (as signed long)."""
    return F.shiftright(hashed, 64 - bits) + F.lit(1 << (bits - 1)) if bits else F.lit(0).cast("long")


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of value over the rows before, by (bucket, order) within keys.

    Two levels: sums per bucket are added up first, so a hot key is spread over its buckets and
    no task gets more than the rows of a bucket. keys and bucket must not be null. df is read
    twice: write it out first if it costs much.
    """
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(before, [*keys, bucket]).withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local")


def _bytes(told: str) -> int:
    """A number with Spark's unit of bytes, if any."""
    told = told.strip().lower().removesuffix("b")
    return int(told[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[told[-1]] if told[-1:].isalpha() else int(told)


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, which need not find it on their own path, and bounds their Arrow batches."""
    # what a worker holds of one batch, beside the objects made of it
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)):
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))
    context = spark.sparkContext
    if getattr(context, "_proofloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="proofloom-")) / "proofloom_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._proofloom_shipped = True
