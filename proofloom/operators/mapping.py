"""Mapping of snapshots in stages that consume vertices, correspondence of obligations, preserved rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written


def staged(before: DataFrame, after: DataFrame, stages: list[tuple[str, list[str]]], renames: DataFrame | None = None) -> DataFrame:
    """(source, target, stage) over rows (k, columns): each stage pairs vertices whose columns are equal and alone on both sides.

    What a stage pairs is consumed; the rest is removed or added. Each stage is written out, so plans do not grow over the stages. A stage called rename pairs by renames(old, new) of
    the stage's first column. Rows with a null in a stage's columns do not take part in it.
    """
    left, right, found = before, after, []
    for name, columns in stages:
        a, b = left, right
        if name == "rename" and renames is not None:
            a = a.join(renames.select(F.col("old").alias(columns[0]), "new"), columns[0]).drop(columns[0]).withColumnRenamed("new", columns[0])
        alone = lambda d, c: d.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), F.min("k").alias(c)).where("_n = 1").drop("_n")
        hit = written(alone(a, "source").join(alone(b, "target"), columns).select("source", "target", F.lit(name).alias("stage")), "stage")
        found.append(hit)
        left = written(left.join(hit.select(F.col("source").alias("k")), "k", "left_anti"), "left")
        right = written(right.join(hit.select(F.col("target").alias("k")), "k", "left_anti"), "right")
    none = F.lit(None).cast(dict(before.dtypes)["k"])
    found.append(left.select(F.col("k").alias("source"), none.alias("target"), F.lit("removed").alias("stage")))
    found.append(right.select(none.alias("source"), F.col("k").alias("target"), F.lit("added").alias("stage")))
    return reduce(DataFrame.unionByName, found)


def correspondence(before: DataFrame, after: DataFrame, mapped: DataFrame) -> DataFrame:
    """(key, status) of obligations(id, rule, property, target) of two snapshots under a mapping(source, target) of their targets.

    key is rule|property|target in the second snapshot's ids. One on either side: corresponds; only before: removed; only after:
    added; a target without a mapping: mapping_unresolved; several of a key: ambiguous.
    """
    key = lambda c: F.concat_ws("|", "rule", "property", F.col(c).cast("string"))
    moved = before.join(mapped.select(F.col("source").alias("target"), F.col("target").alias("_to")), "target", "left")
    lost = moved.where("_to IS NULL").select(key("target").alias("key"), F.lit("mapping_unresolved").alias("status"))
    a = moved.where("_to IS NOT NULL").groupBy(key("_to").alias("key")).agg(F.count(F.lit(1)).alias("a"))
    b = after.groupBy(key("target").alias("key")).agg(F.count(F.lit(1)).alias("b"))
    rows = a.join(b, "key", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when((F.col("a") > 1) | (F.col("b") > 1), "ambiguous").otherwise("corresponds")
    return rows.select("key", status.alias("status")).union(lost)


def preserved(mapped: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(k, ..) carried over to the targets of mapped(source, target, status) where the pair is preserved; of two pairs with the same ends, each by its own status."""
    keep = mapped.where("status = 'preserved' AND target IS NOT NULL")
    return rows.join(keep.select(F.col("source").alias("k"), "target"), "k").drop("k").withColumnRenamed("target", "k").select(*rows.columns)


def pair_compatibility(rows: DataFrame, unit: list[str], arm: str, arms: tuple[str, str], columns: list[str]) -> DataFrame:
    """(unit, outcome) of rows of two arms: compatible if all columns are equal, else the first that differs; missing_<arm> without a row."""
    side = lambda name, p: rows.where(F.col(arm) == name).select(*unit, *[F.col(c).alias(f"{p}_{c}") for c in columns], F.lit(True).alias(p))
    joined = side(arms[0], "x").join(side(arms[1], "y"), unit, "full_outer")
    out = F.when(F.col("x").isNull(), f"missing_{arms[0]}").when(F.col("y").isNull(), f"missing_{arms[1]}")
    for c in columns:
        out = out.when(~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")), f"{c}_differs")
    return joined.select(*unit, out.otherwise("compatible").alias("outcome"))


def exact_cover(entries: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """(key, problem) of assessment entries(members array, decisive, evidence, verification) against a universe(key).

    uncovered and unknown members, those covered twice, and members of decisive entries without evidence or verification.
    """
    rows = entries.select(F.explode_outer("members").alias(key), (F.col("decisive") & ((F.col("evidence") == 0) | (F.col("verification") == 0))).alias("weak")).where(F.col(key).isNotNull())
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("weak").alias("weak"))
    joined = universe.select(key, F.lit(True).alias("u")).distinct().join(sums, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "uncovered").when(F.col("u").isNull(), "unknown_member").when(F.col("n") > 1, "covered_twice").when(F.col("weak"), "decisive_without_proof")
    return joined.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def bridge(changed_by: DataFrame, symbols: DataFrame, changes: DataFrame, contains: DataFrame) -> DataFrame:
    """(symbol, change, outcome) of changed_by edges: excluded if an end is missing, bridged if a container of the symbol holds the change, else candidate.

    Only edges with both ends look for a container: each meets its symbol's containers, so a container's members are never paired with each other.
    """
    rows = changed_by.join(symbols.select("symbol", F.lit(True).alias("s")).distinct(), "symbol", "left").join(changes.select("change", F.lit(True).alias("c")).distinct(), "change", "left")
    inside = contains.select("container", "member").distinct()
    asked = changed_by.join(symbols.select("symbol"), "symbol", "left_semi").join(changes.select("change"), "change", "left_semi")
    met = asked.join(inside.withColumnRenamed("member", "symbol"), "symbol").join(inside.withColumnRenamed("member", "change"), ["change", "container"], "left_semi")
    held = met.select("symbol", "change", F.lit(True).alias("b")).distinct()
    outcome = F.when(F.col("s").isNull(), "symbol_missing").when(F.col("c").isNull(), "change_missing").when(F.col("b").isNotNull(), "bridged").otherwise("candidate")
    return rows.join(held, ["symbol", "change"], "left").select("symbol", "change", outcome.alias("outcome"))


def dependencies(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, needs, outcome, manifest) of edges(package, needs, path): local with the manifest of the package at path, else the reason."""
    known = packages.select(F.col("manifest"), F.col("directory").alias("path"), F.col("name").alias("needs"), F.lit(True).alias("l"))
    rows = edges.join(known, ["path", "needs"], "left")
    return rows.select("package", "needs", F.when(F.col("l"), "local").when(F.col("path").isNull(), "registry").otherwise("local_manifest_missing").alias("outcome"), "manifest")
