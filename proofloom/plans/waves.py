"""Dependency waves under a budget, levels, walks with depth budgets. Rounds are written out: no lineage grows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import risk_rank
from ..store import discard, written


def _ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds name: the place from 0 in the order; sorted by range, so no task gets all rows, and counted up over the ranges."""
    at = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    rows = at.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row for each range of the sort
    return rows.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds name: row_number() over the whole table from 1, as a range sort with offsets instead of one task."""
    return _ranked(df, order, name).withColumn(name, F.col(name) + 1)


def levels(nodes: DataFrame, depends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, level), edges left): level is the longest way down to a node without prerequisites; edges left lie on or behind a cycle.

    nodes(id), depends(id, on). Peels nodes without open prerequisites; a round for each level, one table a round.
    """
    edges = written(depends.select("id", "on").distinct(), "edges")
    n, level, placed = edges.count(), 0, None
    while n:
        rest = written(edges.join(edges.select(F.col("id").alias("on")).distinct(), "on", "left_semi").select("id", "on"), "edges")
        m = rest.count()
        done = written(edges.select("id").distinct().join(rest.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(level + 1)), "level")
        placed = done if placed is None else placed.unionByName(done)
        discard(edges)
        edges, level = rest, level + 1
        if m == n:
            break
        n = m
    first = nodes.select("id").join(depends.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(0))
    return (first if placed is None else first.unionByName(placed)), edges


def has_cycle(nodes: DataFrame, depends: DataFrame) -> bool:
    return not levels(nodes, depends)[1].isEmpty()


def waves(obligations: DataFrame, depends: DataFrame, max_waves: int, per_wave: int) -> DataFrame:
    """(id, wave, pos, deferred): ready ones by impact, depth, id; a wave takes per_wave of them.

    obligations(id, weight), depends(id, on). Prerequisite and successor never share a wave. Left over:
    budget_exhausted if ready, else prerequisite_deferred. A cycle raises ValueError first. Where no level is wider than a wave,
    waves are levels; else the loop runs max_waves times at most.
    """
    known = obligations.select("id")
    inner = depends.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "on"), "on", "left_semi").select("id", "on")
    level, cyclic = levels(obligations, inner)
    if not cyclic.isEmpty():
        raise ValueError("dependencies have a cycle")
    rows = written(obligations.select("id", "weight").join(level, "id"), "levels")
    widths = {r[0]: r[1] for r in rows.groupBy("level").count().orderBy("level").collect()}  # a row a level
    if not widths or max(widths.values()) <= per_wave:
        placed = rows.select("id", "weight", F.col("level").alias("depth"), F.when(F.col("level") < max_waves, F.col("level")).alias("wave"))
        waiting = rows.where(F.col("level") > max_waves).select("id")
    else:
        placed, waiting = _budgeted(rows.select("id", "weight"), inner, max_waves, per_wave)
    done = placed.where("wave IS NOT NULL")
    at = _ranked(done, ["wave", F.desc(risk_rank(F.col("weight"))), F.desc("depth"), "id"], "_place")
    starts = at.groupBy("wave").agg(F.min("_place").alias("_start"))
    at = at.join(starts, "wave").select("id", "wave", (F.col("_place") - F.col("_start")).cast("int").alias("pos"), F.lit(None).cast("string").alias("deferred"))
    none = F.lit(None).cast("int")
    rest = placed.where("wave IS NULL").join(waiting.select("id", F.lit(True).alias("_w")).distinct(), "id", "left")
    return at.unionByName(rest.select("id", none.alias("wave"), none.alias("pos"), F.when(F.col("_w"), "prerequisite_deferred").otherwise("budget_exhausted").alias("deferred")))


def _budgeted(obligations: DataFrame, edges: DataFrame, max_waves: int, per_wave: int) -> tuple[DataFrame, DataFrame]:
    """((id, weight, depth, wave), waiting ids): one round a wave; a node's depth grows as its prerequisites are placed."""
    left = written(obligations.select("id", "weight", F.lit(0).alias("depth")), "left")
    placed = left.limit(0).withColumn("wave", F.lit(None).cast("int"))
    for wave in range(max_waves):
        waiting = edges.join(left.select(F.col("id").alias("on")), "on", "left_semi").select("id").distinct()
        ready = left.join(waiting, "id", "left_anti")
        taken = written(ready.orderBy(F.desc(risk_rank(F.col("weight"))), F.desc("depth"), "id").limit(per_wave), "taken")
        if taken.isEmpty():
            break
        placed = placed.unionByName(taken.withColumn("wave", F.lit(wave)))
        deeper = edges.join(taken.select(F.col("id").alias("on"), "depth"), "on").groupBy("id").agg((F.max("depth") + 1).alias("_d"))
        rest = left.join(taken.select("id"), "id", "left_anti").join(deeper, "id", "left")
        after = written(rest.select("id", "weight", F.greatest("depth", F.coalesce("_d", F.lit(0))).alias("depth")), "left")
        discard(left)
        left = after
    waiting = edges.join(left.select(F.col("id").alias("on")), "on", "left_semi").select("id").distinct()
    return placed.unionByName(left.withColumn("wave", F.lit(None).cast("int"))), waiting


def chain_levels(obligations: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """(id, level): place in the chain of a stream, where each depends on the one before."""
    return obligations.select("id", (F.row_number().over(Window.partitionBy(stream).orderBy(*order)) - 1).cast("long").alias("level"))


def reachable(seeds: DataFrame, edges: DataFrame, budgets: dict[str, int], max_rounds: int = 16) -> DataFrame:
    """(node, depth): least depth at which a walk from a seed gets to node.

    edges(kind, src, dst), both directions given as edges. Within one kind a walk makes at most budgets[kind] steps; a change of
    kind starts anew. States (node, kind, steps left) are visited once; rounds are bounded.
    """
    spark = seeds.sparkSession
    dim = F.broadcast(spark.createDataFrame(list(budgets.items()), "kind string, most int"))
    steps = edges.join(dim, "kind")
    front = written(seeds.select("node", F.lit("").alias("token"), F.lit(0).alias("left"), F.lit(0).alias("depth")), "front")
    seen = front
    for depth in range(1, max_rounds + 1):
        step = front.join(steps, front["node"] == steps["src"])
        left = F.when(F.col("token") == F.col("kind"), F.col("left") - 1).otherwise(F.col("most") - 1)
        step = step.select(F.col("dst").alias("node"), F.col("kind").alias("token"), left.alias("left")).where("left >= 0").distinct()
        front = written(step.join(seen.select("node", "token", "left"), ["node", "token", "left"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select(*seen.columns))
    return seen.groupBy("node").agg(F.min("depth").alias("depth"))
