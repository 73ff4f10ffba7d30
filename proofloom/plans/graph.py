"""Closures over graphs: relevant ids, impact cones, staleness, ancestors, candidate components. Each round is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import components, written


def spread(front: DataFrame, step, keys: list[str], most: int | None = None) -> DataFrame:
    """Rows of front and all that step(front) leads to, each with its least depth; rows are known by their keys.

    Semi-naive: a round joins only rows that are new. Ends when none is, or after `most` rounds.
    """
    front = written(front.select(*keys).distinct().withColumn("depth", F.lit(0)), "front")
    seen, depth = front, 0
    while most is None or depth < most:
        depth += 1
        new = step(front).select(*keys).distinct().join(seen.select(*keys), keys, "left_anti")
        front = written(new.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def relevant(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of every id in an undirected component with a seed; seeds without edges stay.

    By components, whose rounds do not grow with the distance from a seed.
    """
    root = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    hit = root.join(seeds.select("node"), "node", "left_semi").select("root").distinct()
    return root.join(hit, "root", "left_semi").select("node").union(seeds.select("node")).distinct()


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of every node above each node; parents(node, parent) has no cycle.

    Ways of length 2**i are joined with ways up to that length, so the rounds grow with the logarithm of the depth.
    """
    every = written(parents.where("node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "ancestors")
    jump, length = every, 1
    while not jump.isEmpty():
        up = jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("depth").alias("_d"))
        longer = every.join(up, "ancestor").select("node", F.col("_up").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        every = written(every.unionByName(longer), "ancestors")
        length *= 2
        jump = written(every.where(F.col("depth") == length), "jump")
    return every


def impact_cone(seeds: DataFrame, edges: DataFrame, policy: DataFrame) -> DataFrame:
    """(rule, node, depth): nodes within a rule's depth of a seed, over the edge kinds and directions its policy names.

    seeds(node), edges(kind, src, dst), policy(rule, kind, direction, depth): direction out, in or both; one depth a rule and kind.
    """
    both = edges.select("kind", F.lit("out").alias("way"), F.col("src").alias("node"), F.col("dst").alias("_to"))
    both = both.unionByName(edges.select("kind", F.lit("in").alias("way"), F.col("dst").alias("node"), F.col("src").alias("_to")))
    ways = F.when(F.col("direction") == "both", F.array(F.lit("out"), F.lit("in"))).otherwise(F.array("direction"))
    allowed = F.broadcast(policy.select("rule", "kind", F.explode(ways).alias("way"), F.col("depth").alias("_most")))  # a policy table: a few rows a rule
    steps = both.join(allowed, ["kind", "way"]).select("rule", "node", "_to", "_most")
    most = policy.agg(F.max("depth")).first()[0] or 0
    front = seeds.select("node").distinct().crossJoin(F.broadcast(policy.select("rule").distinct()))
    return spread(front, lambda f: f.join(steps, ["rule", "node"]).where(F.col("depth") < F.col("_most")).select("rule", F.col("_to").alias("node")), ["rule", "node"], most)


def staleness(changed: DataFrame, depends: DataFrame) -> DataFrame:
    """(id, directness, reasons): reasons of an id's own changes, dependency_changed for those of what it depends on, sorted.

    changed(id, reason), depends(id, on). directness: direct, indirect or direct_and_indirect.
    """
    on = depends.select(F.col("on").alias("id"), F.col("id").alias("_child")).distinct()
    reached = spread(changed.select("id"), lambda f: f.join(on, "id").select(F.col("_child").alias("id")), ["id"]).select("id")
    behind = reached.join(on, "id").select(F.col("_child").alias("id"), F.lit("dependency_changed").alias("reason"), F.lit(0).alias("direct")).distinct()
    rows = behind.unionByName(changed.select("id", "reason", F.lit(1).alias("direct")).distinct())
    direct, indirect = F.max("direct") == 1, F.min("direct") == 0
    kind = F.when(direct & indirect, "direct_and_indirect").when(direct, "direct").otherwise("indirect")
    return rows.groupBy("id").agg(kind.alias("directness"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def component_status(before: DataFrame, after: DataFrame, candidates: DataFrame) -> DataFrame:
    """(component, sources, targets, status) of the bipartite candidate graph; a vertex without candidates is a component.

    before(k, body), after(k, body), candidates(source, target). component: its smallest vertex, s<k> or t<k> of longs.
    (0, 1) added, (1, 0) removed, (1, 1) preserved if bodies are equal, else modified, (1, n) split, (n, 1) merged, else unresolved.
    """
    name = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    root = components(candidates.select(name("s", "source").alias("a"), name("t", "target").alias("b")))
    rows = before.select(name("s", "k").alias("node"), "body", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(after.select(name("t", "k").alias("node"), "body", F.lit(0).alias("s"), F.lit(1).alias("t")))
    rows = rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = rows.groupBy("root").agg(F.min("node").alias("component"), F.sum("s").alias("sources"), F.sum("t").alias("targets"), (F.min("body") == F.max("body")).alias("same"))
    s, t = F.col("sources"), F.col("targets")
    status = F.when(s == 0, "added").when(t == 0, "removed").when((s == 1) & (t == 1), F.when(F.col("same"), "preserved").otherwise("modified"))
    return sums.select("component", "sources", "targets", status.when(s == 1, "split").when(t == 1, "merged").otherwise("unresolved").alias("status"))


# Stages of a rerun, in order.
RERUN = ["reproject", "reviewer", "verifier", "human"]


def rerun_actions(stale: DataFrame) -> DataFrame:
    """(id, position, action, after) of every stale obligation: the stages in order, each after the one before."""
    stages = F.array(*[F.lit(s) for s in RERUN])
    rows = stale.select("id", F.posexplode(stages).alias("position", "action"))
    return rows.withColumn("after", F.when(F.col("position") > 0, F.element_at(stages, F.col("position"))))


# Reasons why a file is left out of a context, strongest first.
EXCLUSIONS = ["path_cap", "test_cap", "not_reached", "included_file_cap", "artifact_bytes_cap", "total_resolved_bytes_cap", "giant_line", "excerpt_bytes_cap", "total_excerpt_bytes_cap"]


def exclusion(rows: DataFrame, flags: dict[str, object]) -> DataFrame:
    """rows with excluded_by: the first of EXCLUSIONS whose flag (a Column) holds, null for files that stay."""
    return rows.withColumn("excluded_by", F.coalesce(*[F.when(flags[name], F.lit(name)) for name in EXCLUSIONS if name in flags]))
