"""Call resolution in tiers, call edges, range joins for scoring, line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_calls(sites: DataFrame, declared: DataFrame) -> DataFrame:
    """(call_id, tier, candidates, confidence): same scope first, then by name; exact, name_only, ambiguous or unresolved.

    Declarations are counted by name and by name and scope first, so a call meets one row of each, however often a name is declared.
    """
    far = declared.groupBy("name").agg(F.count(F.lit(1)).alias("far"))
    near = declared.groupBy("name", "scope").agg(F.count(F.lit(1)).alias("near"))
    n = sites.select("call_id", "scope", "name").join(far, "name", "left").join(near, ["name", "scope"], "left").fillna(0, ["far", "near"])
    tier = F.when(F.col("near") > 0, "scope").when(F.col("far") > 0, "name").otherwise("none")
    count = F.when(F.col("near") > 0, F.col("near")).otherwise(F.col("far"))
    confidence = F.when(count == 0, "unresolved").when(count > 1, "ambiguous").when(F.col("near") == 1, "exact").otherwise("name_only")
    return n.select("call_id", "scope", "name", tier.alias("tier"), count.alias("candidates"), confidence.alias("confidence"))


def call_stats(resolved: DataFrame, fan_out: int = 5) -> DataFrame:
    """Calls by confidence, zero-filled; ambiguous ones with more than fan_out candidates apart."""
    kinds = ["exact", "name_only", "ambiguous", "over_fanout", "unresolved"]
    fixed = resolved.sparkSession.createDataFrame([(k,) for k in kinds], "confidence string")
    kind = F.when((F.col("confidence") == "ambiguous") & (F.col("candidates") > fan_out), "over_fanout").otherwise(F.col("confidence"))
    return fixed.join(resolved.groupBy(kind.alias("confidence")).agg(F.count(F.lit(1)).alias("n")), "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))


def overlapping(findings: DataFrame, roots: DataFrame, width: int = 4) -> DataFrame:
    """(finding, root) of one path and tag whose closed line ranges meet.

    Both sides are dealt into cells of `width` lines, and each pair is kept in its first common cell, so a hot path and tag is
    split by lines and nothing need be made distinct but repeated rows.
    """
    cells = lambda d: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    f, r = cells(findings).alias("f"), cells(roots).alias("r")
    on = (F.col("f.path") == F.col("r.path")) & (F.col("f.tag") == F.col("r.tag")) & (F.col("f.cell") == F.col("r.cell")) & (F.col("f.s") <= F.col("r.e")) & (F.col("r.s") <= F.col("f.e"))
    return f.join(r, on).where(F.col("f.cell") == F.floor(F.greatest("f.s", "r.s") / width)).select("finding", "root").distinct()


def score(findings: DataFrame, roots: DataFrame) -> DataFrame:
    """One row: detected roots, matched and unmatched findings."""
    hit = overlapping(findings, roots)
    return hit.agg(F.countDistinct("root").alias("detected"), F.countDistinct("finding").alias("matched")).crossJoin(findings.agg(F.countDistinct("finding").alias("_all"))).select("detected", "matched", (F.col("_all") - F.col("matched")).alias("unmatched"))


def windows(seeds: DataFrame, lines: int, pad: int = 48, most_lines: int = 160, most_windows: int = 8) -> DataFrame:
    """(path, s, e, seeds, omitted): seeds padded, each cut to most_lines, merged where they meet, the first few per path kept."""
    s = F.greatest(F.lit(1), F.col("s") - pad)
    padded = seeds.select("path", s.cast("long").alias("s"), F.least(F.lit(lines), F.col("e") + pad, s + most_lines - 1).cast("long").alias("e"), "id")
    w = Window.partitionBy("path").orderBy("s", "e", "id")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = padded.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w))
    merged = island.groupBy("path", "_i").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("seeds"))
    rank, total = F.row_number().over(Window.partitionBy("path").orderBy("s")), F.count(F.lit(1)).over(Window.partitionBy("path"))
    return merged.withColumns({"_r": rank, "omitted": F.greatest(F.lit(0), total - most_windows)}).where(F.col("_r") <= most_windows).drop("_r", "_i")
