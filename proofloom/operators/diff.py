"""Differences of snapshots: member changes, mapping with consumed vertices, admission, component status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def member_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, reason): added, removed, <column>_changed joined by '+', or preserved."""
    a, b = before.select(key, *columns, F.lit(True).alias("_in")), after.select(key, *columns, F.lit(True).alias("_in"))
    rows = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"{c}_changed")) for c in columns])), "+")
    reason = F.when(F.col("a._in").isNull(), "added").when(F.col("b._in").isNull(), "removed").when(changed != "", changed).otherwise("preserved")
    return rows.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), reason.alias("reason"))


def staged_mapping(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """(source, target, stage): equal keys first; of what is left, labels unique on both sides; the rest unmapped."""
    none = F.lit(None).cast(before.schema[key].dataType)
    one = before.select(F.col(key).alias("source")).join(after.select(F.col(key).alias("target")), F.col("source") == F.col("target")).select("source", "target", F.lit("key").alias("stage"))
    left = before.select(F.col(key).alias("source"), label).join(one, "source", "left_anti")
    right = after.select(F.col(key).alias("target"), label).join(one, "target", "left_anti")
    alone = lambda df, c: df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min(c).alias(c)).where("_n = 1").drop("_n")
    two = alone(left, "source").join(alone(right, "target"), label).select("source", "target", F.lit("label").alias("stage"))
    removed = left.join(two, "source", "left_anti").select("source", none.alias("target"), F.lit("removed").alias("stage"))
    added = right.join(two, "target", "left_anti").select(none.alias("source"), "target", F.lit("added").alias("stage"))
    return one.unionByName(two).unionByName(removed).unionByName(added)


def component_status(before: DataFrame, after: DataFrame, key: str, body: str) -> DataFrame:
    """Per key: preserved, modified, added, removed, split, merged or unresolved by the counts on either side."""
    side = lambda df, p: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.min(body).alias(f"{p}_b"))
    rows = side(before, "s").join(side(after, "t"), key, "full_outer").select(key, F.coalesce("s_n", F.lit(0)).alias("s"), F.coalesce("t_n", F.lit(0)).alias("t"), F.col("s_b").eqNullSafe(F.col("t_b")).alias("same"))
    status = F.when(F.col("s") == 0, "added").when(F.col("t") == 0, "removed").when((F.col("s") == 1) & (F.col("t") == 1), F.when(F.col("same"), "preserved").otherwise("modified"))
    return rows.select(key, status.when(F.col("s") == 1, "split").when(F.col("t") == 1, "merged").otherwise("unresolved").alias("status"))


def admission(expected: DataFrame, submitted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problem): missing, extra, mismatched or duplicate keys; no row for a key that is right."""
    got = submitted.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("got"))
    rows = expected.select(key, F.col(value).alias("want"), F.lit(True).alias("e")).join(got, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("n") > 1, "duplicate").when(~F.col("want").eqNullSafe(F.col("got")), "mismatched")
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def partition_faults(declared: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Keys that are not in exactly one part: (key, times)."""
    n = parts.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return declared.select(key).distinct().join(n, key, "full_outer").select(key, F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


def ordinals(rows: DataFrame, path: str, name: str, order: list[str]) -> DataFrame:
    """Adds stable_key: the name, with ~n from the second of equal names of a path on."""
    n = F.row_number().over(Window.partitionBy(path, name).orderBy(*order))
    return rows.withColumn("stable_key", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("~"), n)))
