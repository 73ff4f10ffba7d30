"""Rendezvous (highest random weight) hashing of stable record keys over weighted shards. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, hash_bucket, running, written


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard whose score -w / ln(u(key, shard)) is largest.

    Only key and the shard's own number and weight go into a score: a shard that is added takes
    the keys it wins and moves no other; a shard of weight w gets a share of w / sum(weights).
    A null key counts as a key of its own.
    """
    known = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = []
    for shard, weight in enumerate(weights):
        unit = (F.shiftrightunsigned(F.xxhash64(known, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(unit)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_max(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def shard_rows(rows: DataFrame, key: str, weights: list[float], new_weight: float = 1.0) -> DataFrame:
    """Adds shard, slot (gapless from 0 in each shard, by hash of the key) and grown_shard.

    rows: narrow rows (no texts; keep key, sizes, checksums). Equal keys go to one shard, whose
    rows are ordered by all their columns, so reruns agree. An empty table gives an empty one. Columns called like the added ones are replaced.
    """
    rows = rows.drop("shard", "slot", "grown_shard")
    known = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    dealt = rows.withColumns({
        "shard": rendezvous(F.col(key), weights),
        "grown_shard": rendezvous(F.col(key), [*weights, new_weight]),
        "_hash": F.xxhash64(known, *[c for c in rows.columns if c != key]),
    })
    dealt = written(dealt, "shards")
    bits = bucket_bits(dealt.count() // max(1, len(weights)))
    dealt = dealt.withColumn("_bucket", hash_bucket(F.col("_hash"), bits))
    order = [F.col("_hash"), F.col(key)]
    return running(dealt, ["shard"], "_bucket", order, F.lit(1).cast("long"), "slot").drop("_bucket", "_hash")
