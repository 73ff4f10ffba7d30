"""Review-state queries: run summaries, call edges, reports, gates, neighbourhoods, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import UNRESOLVED_REASONS


def strongest_reason(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """(key, reason) with the strongest of the reasons of a key; unknown ones are weakest."""
    known = F.array(*[F.lit(r) for r in UNRESOLVED_REASONS])
    rank = F.array_position(known, F.col(reason))
    return rows.groupBy(key).agg(F.min_by(reason, F.struct(F.when(rank == 0, F.lit(99)).otherwise(rank), F.col(reason))).alias("reason"))


def call_edges(resolved: DataFrame, sites: DataFrame, declared: DataFrame, fan_out: int = 5) -> DataFrame:
    """(scope, callee, confidence, sites): one edge per caller scope and callee with its strongest confidence; over fan_out none."""
    keep = resolved.where((F.col("confidence") != "unresolved") & ~((F.col("confidence") == "ambiguous") & (F.col("candidates") > fan_out)))
    target = declared.select("name", F.col("k").alias("callee"), F.col("scope").alias("home"))
    hit = keep.join(target, "name").where((F.col("tier") == "name") | (F.col("home") == F.col("scope")))
    rank = F.when(F.col("confidence") == "exact", 0).when(F.col("confidence") == "name_only", 1).otherwise(2)
    return hit.groupBy("scope", "callee").agg(F.min_by("confidence", rank).alias("confidence"), F.countDistinct("call_id").alias("sites"))


def removed_callers(removed: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(k, call_id): unresolved calls by the name of a removed callable, a row each; null for a callable without any."""
    return removed.select("k", "name").join(unresolved.select("name", "call_id"), "name", "left").select("k", "call_id")


def neighbourhood(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, src, dst): edges that start or end at a selected node; two equi joins instead of an OR."""
    out = edges.join(selected.select(F.col("k"), F.col("k").alias("src")), "src").select("k", "src", "dst")
    return out.union(edges.join(selected.select(F.col("k"), F.col("k").alias("dst")), "dst").select("k", "src", "dst")).distinct()


def overlapping_spans(spans: DataFrame, width: int = 4) -> DataFrame:
    """(a, b), a < b: spans of one path that meet. Of two such spans one holds the other's start, so starts meet the spans over their cell of `width` lines.

    Each pair is met once, in the cell of its later start (of equal starts, that of the larger id). Small tables make many pairs, so cells are dealt
    into as many tasks as shuffles have partitions, whatever their bytes.
    """
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    over = spans.where("s <= e").select("path", "id", "s", "e", F.explode(F.sequence(F.expr(f"s div {width}"), F.expr(f"e div {width}"))).alias("cell")).repartition(tasks, "path", "cell")
    starts = spans.select("path", "id", "s", "e", F.expr(f"s div {width}").alias("cell")).repartition(tasks, "path", "cell")
    x, y = over.alias("x"), starts.alias("y")
    later = (F.col("x.s") < F.col("y.s")) | ((F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")))
    met = (F.col("x.path") == F.col("y.path")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("y.s") <= F.col("x.e")) & (F.col("x.s") <= F.col("y.e")) & later
    return x.join(y, met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def follow_chain(start: DataFrame, links: DataFrame, most: int = 8) -> DataFrame:
    """(id, last, hops): where a re-export chain from id ends after at most `most` links; joins unrolled."""
    at = start.select("id", F.col("id").alias("last"), F.lit(0).alias("hops"))
    step = links.select(F.col("src").alias("last"), F.col("dst").alias("_next"))
    for _ in range(most):
        at = at.join(step, "last", "left").select("id", F.coalesce("_next", "last").alias("last"), (F.col("hops") + F.when(F.col("_next").isNotNull(), 1).otherwise(0)).alias("hops"))
    return at


def run_summary(inventory: DataFrame, collected: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """(status, n): scored, unscored, missing by exclusive precedence; every inventory row counts once."""
    mark = lambda d, c: d.select(key).distinct().withColumn(c, F.lit(True))
    rows = inventory.select(key).distinct().join(mark(collected, "c"), key, "left").join(mark(scored, "s"), key, "left")
    status = F.when(F.col("c").isNull(), "missing").when(F.col("s").isNull(), "unscored").otherwise("scored")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def gate(rows: DataFrame, required: Column, passed: Column) -> DataFrame:
    """(k, gate): pass if all required rows passed, blocked if one did not, incomplete without required rows."""
    g = rows.groupBy("k").agg(F.count_if(required).alias("need"), F.count_if(required & passed).alias("ok"))
    return g.select("k", F.when(F.col("need") == 0, "incomplete").when(F.col("need") == F.col("ok"), "pass").otherwise("blocked").alias("gate"))


def excerpt(docs: DataFrame, text: str, first: int, lines: int) -> Column:
    """Lines first to first + lines - 1 of a text."""
    return F.array_join(F.slice(F.split(F.col(text), "\n"), first, lines), "\n")


def members_times_properties(members: DataFrame, family: str, fixed: list[str], each: list[str]) -> DataFrame:
    """(family, member, property): fixed ones once a family, the others for every member."""
    lit = lambda names: F.explode(F.array(*[F.lit(x) for x in names]))
    one = members.select(family).distinct().select(family, F.lit(None).cast("long").alias("member"), lit(fixed).alias("property"))
    return one.unionByName(members.select(family, "member", lit(each).alias("property")))


def last_valid(decisions: DataFrame, invalidations: DataFrame, key: str) -> DataFrame:
    """(key, seq, value): the last decision of a key that no later invalidation strikes."""
    last = decisions.groupBy(key).agg(F.max(F.struct("seq", "value")).alias("d"))
    struck = invalidations.groupBy(key).agg(F.max("seq").alias("struck"))
    return last.join(struck, key, "left").where(F.col("struck").isNull() | (F.col("struck") < F.col("d.seq"))).select(key, "d.seq", "d.value")


def superseded(findings: DataFrame, key: str) -> DataFrame:
    """findings with the id of the one each replaces."""
    return findings.withColumn("supersedes", F.lag("id").over(Window.partitionBy(key).orderBy("seq")))


def json_report(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, report): a canonical JSON object of the columns in alphabetical order."""
    return rows.select(key, F.to_json(F.struct(*sorted(columns))).alias("report"))
