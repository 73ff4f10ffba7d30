"""Evidence algebra: connected support, verification, freshness, coverage axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(bindings: DataFrame, current: Column) -> DataFrame:
    """Per obligation: supported, verified (every binding passed and there is one), freshness."""
    return bindings.groupBy("k").agg(
        F.max(F.col("relation") != "R").alias("supported"),
        F.min(F.col("outcome") == "F").alias("verified"),
        F.when(F.max(F.col("snapshot") != current), "stale").otherwise("fresh").alias("freshness"),
    )


def axes(obligations: DataFrame, flagged: DataFrame) -> DataFrame:
    """obligations with every axis; no evidence means not supported, not verified, freshness unknown."""
    rows = obligations.join(flagged, "k", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("k", "weight", (F.col("status") == "F").alias("completed"), no("supported").alias("supported"), no("verified").alias("verified"), F.coalesce("freshness", F.lit("unknown")).alias("freshness"))


def coverage(rows: DataFrame) -> DataFrame:
    """(axis, qualified, denominator, ratio, weighted): ratios are 0 where the denominator is."""
    marks = {"completed": F.col("completed"), "supported": F.col("supported"), "verified": F.col("verified"), "fresh": F.col("verified") & (F.col("freshness") == "fresh")}
    every = F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("q")) for a, c in marks.items()])
    long = rows.select("weight", F.explode(every).alias("x")).select("weight", "x.axis", "x.q")
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 6))
    w = F.col("weight").cast("decimal(18,6)")
    sums = long.groupBy("axis").agg(F.count_if("q").alias("qualified"), F.count(F.lit(1)).alias("denominator"), F.sum(F.when(F.col("q"), w).otherwise(0)).cast("double").alias("qw"), F.sum(w).cast("double").alias("tw"))
    return sums.select("axis", "qualified", "denominator", ratio(F.col("qualified"), F.col("denominator")).alias("ratio"), ratio(F.col("qw"), F.col("tw")).alias("weighted"))


def histogram(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of each value, 0 for those that do not occur."""
    fixed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return fixed.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def violations(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key has no parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")
