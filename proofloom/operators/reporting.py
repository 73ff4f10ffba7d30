"""Reports with declared loss, discovery denominators and ranks, set checks over ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import digest
from ..plans.waves import rank

# Columns of each projection of a report; what a projection leaves out is its loss.
PROJECTIONS = {"human": ["id", "status", "weight"], "ai": ["id", "status", "stream", "weight"], "audit": ["id", "made_at", "status", "stream", "weight"], "ci": ["id", "status"]}


def projections(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, projection, report, loss): each projection as JSON of its columns in alphabetical order, and the columns it leaves out."""
    out = []
    for name, kept in PROJECTIONS.items():
        some = sorted(c for c in kept if c in columns)
        lost = ",".join(sorted(set(columns) - set(some)))
        out.append(rows.select(key, F.lit(name).alias("projection"), F.to_json(F.struct(*some)).alias("report"), F.lit(lost).alias("loss")))
    return reduce(DataFrame.unionByName, out)


def denominators(rows: DataFrame, ladder: list[tuple[str, Column]], rest: str = "eligible") -> DataFrame:
    """(reason, n): each row under the first reason of the ladder that holds, 0 for reasons without a row."""
    kind = F.coalesce(*[F.when(c, F.lit(name)) for name, c in ladder], F.lit(rest))
    names = rows.sparkSession.createDataFrame([(n,) for n in [*[n for n, _ in ladder], rest]], "reason string")
    return names.join(rows.groupBy(kind.alias("reason")).agg(F.count(F.lit(1)).alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def signal_ranks(pairs: DataFrame, first: str, second: str, ids: list[str]) -> DataFrame:
    """pairs with rank 1..n: by first and second descending, then ids; a range sort with offsets, not one task."""
    return rank(pairs, [F.desc(first), F.desc(second), *[F.col(i) for i in ids]])


def unresolved(rows: DataFrame, by: list[str], id_: str) -> DataFrame:
    """Counts with a digest of the sorted id set per bucket. The digest is of the digests of 256 parts of the ids, so no task holds a bucket whole."""
    part = F.substring(F.sha2(F.col(id_).cast("string"), 256), 1, 2)
    parts = rows.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), digest(F.collect_list(F.col(id_).cast("string"))).alias("_d"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_d"))), lambda x: x["_d"]), ",")
    return parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(every, 256).alias("ids"))


def capped_union(sides: list[DataFrame], key: str, most: int) -> DataFrame:
    """(ids, over): the size of the union of id sets and whether it is over the cap."""
    every = reduce(DataFrame.union, [d.select(key) for d in sides]).distinct()
    return every.agg(F.count(F.lit(1)).alias("ids"), (F.count(F.lit(1)) > most).alias("over"))


def overlap(members: DataFrame, context: str, member: str, pairs: DataFrame) -> DataFrame:
    """(a, b, shared) of asked pairs(a, b) of contexts: members that both have, 0 for disjoint ones."""
    m = members.select(context, member).distinct()
    met = pairs.join(m.select(F.col(context).alias("a"), member), "a").join(m.select(F.col(context).alias("b"), member), ["b", member]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def term_difference(posted: DataFrame, query: list[str]) -> DataFrame:
    """(id, matched, unmatched): the query's terms that an id has and lacks, sorted, for ids with at least one."""
    asked = sorted(set(query))
    lit = F.array(*[F.lit(t) for t in asked])
    hits = posted.where(F.col("term").isin(asked)).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("m"))
    return hits.select("id", F.array_join("m", ",").alias("matched"), F.array_join(F.array_except(lit, F.col("m")), ",").alias("unmatched"))


def bijection(exported: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """(key, problem) where a blind adjudication does not come back exactly once: missing, unknown or repeated."""
    n = imported.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = exported.select(key, F.lit(True).alias("e")).distinct().join(n, key, "full_outer")
    return rows.select(key, F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unknown").when(F.col("n") > 1, "repeated").alias("problem")).where("problem IS NOT NULL")


def needs_adjudication(matches: DataFrame, findings: DataFrame) -> DataFrame:
    """(finding) of those that do not match exactly one root."""
    one = matches.groupBy("finding").agg(F.countDistinct("root").alias("n")).where("n = 1")
    return findings.select("finding").distinct().join(one, "finding", "left_anti")


def deferral(rows: DataFrame, deferred: Column, applicable: Column) -> DataFrame:
    """One row (deferred, applicable, gate): passes if 20 times the deferred are not more than the applicable."""
    sums = rows.agg(F.count_if(deferred).alias("deferred"), F.count_if(applicable).alias("applicable"))
    return sums.withColumn("gate", F.when(F.col("deferred") * 20 <= F.col("applicable"), "pass").otherwise("blocked"))


def row_limits(tables: dict[str, DataFrame], limits: dict[str, int]) -> DataFrame:
    """(name, n, most, within) of every table against its limit."""
    counts = [d.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(limits[name]).cast("long").alias("most")) for name, d in tables.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("within", F.col("n") <= F.col("most"))


def verifier_plan(obligations: DataFrame, verifiers: DataFrame) -> DataFrame:
    """(id, verifier, state) of every obligation and each verifier of its property: applicable, or unsupported for a deferred verifier; none without any.

    verifiers(property, verifier, deferred) is a descriptor table of a few rows a property.
    """
    rows = obligations.join(F.broadcast(verifiers), "property", "left")
    return rows.select("id", "verifier", F.when(F.col("verifier").isNull(), "none").when(F.col("deferred"), "unsupported").otherwise("applicable").alias("state"))


def observations(rows: DataFrame, by: str, kinds: list[str]) -> DataFrame:
    """(by, one column a kind): the number of observations of each kind."""
    return rows.groupBy(by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def valid_change(rows: DataFrame) -> Column:
    """A change artifact's shape: a known status, a path, and an old path exactly for renames."""
    known = F.coalesce(F.col("status").isin("A", "M", "D", "R", "C", "T"), F.lit(False))
    return known & (F.coalesce(F.length("path"), F.lit(0)) > 0) & (F.col("old_path").isNotNull() == F.col("status").isin("R", "C"))
