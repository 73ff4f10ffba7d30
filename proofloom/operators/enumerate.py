"""Enumerate and defer: every obligation of a run in one order, a budget's worth admitted, the others accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.waves import rank

#: The parts of a run.
PARTS = ("admitted", "deferred", "excluded")


def enumerated(nodes: DataFrame, rules: list[str], excluded: Column, budget: int) -> DataFrame:
    """(id, node, rule, part, place, reason): an obligation for each rule and node(node, key), in the order of key, node and rule.

    excluded: the reason why a node has no obligations to do, null if it has. Of the others the first `budget` are admitted; the rest
    are deferred with reason budget_exhausted. place counts from 1 over those not excluded; ranks are counted over ranges of a sort.
    """
    every = nodes.select("node", "key", excluded.alias("reason"), F.explode(F.array(*[F.lit(r) for r in sorted(set(rules))])).alias("rule"))
    every = every.withColumn("id", F.sha2(F.concat_ws("|", "rule", "node"), 256))
    placed = rank(every.where("reason IS NULL"), [F.col("key"), F.col("node"), F.col("rule")], "place")
    late = F.col("place") > budget
    open_ = placed.select("id", "node", "rule", F.when(late, "deferred").otherwise("admitted").alias("part"), F.col("place").cast("long").alias("place"), F.when(late, "budget_exhausted").alias("reason"))
    return open_.unionByName(every.where("reason IS NOT NULL").select("id", "node", "rule", F.lit("excluded").alias("part"), F.lit(None).cast("long").alias("place"), "reason"))


def accounting(rows: DataFrame) -> DataFrame:
    """(part, n, ids) of rows(id: lower-case hex, part), every part of PARTS: ids is a digest of the digests of the ids that share their first digits.

    The number of digits follows the number of rows, some 1,024 ids share them, so no task holds the ids of a part.
    """
    n = rows.count()
    digits = 1
    while n > 1024 * 16**digits:
        digits += 1
    buckets = rows.groupBy("part", F.substring("id", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("d"))
    parts = buckets.groupBy("part").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256).alias("ids"))
    names = rows.sparkSession.createDataFrame([(p,) for p in PARTS], "part string")
    return names.join(parts, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.sha2(F.lit(""), 256)).alias("ids"))


def cover_faults(declared: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, fault): declared ids in no part (missing), ids in parts that aren't declared (undeclared) or that occur more than once there (repeated)."""
    met = parts.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    joined = declared.select("id").distinct().withColumn("known", F.lit(True)).join(met, "id", "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "undeclared").when(F.col("n") > 1, "repeated")
    return joined.select("id", fault.alias("fault")).where("fault IS NOT NULL")
