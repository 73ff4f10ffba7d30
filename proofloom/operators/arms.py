"""Trials of two arms: what their findings hit, why a trial doesn't count, and what the pairs that count add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import discard, written

#: Rows of findings and targets that one round lets meet.
ROUND = 20_000_000
#: Why a trial does not count, strongest first.
REASONS = ("missing_collection", "protocol_invalid", "collection_binding_invalid", "missing_score", "score_binding_invalid")


def hits(findings: DataFrame, targets: DataFrame, width: int = 8) -> DataFrame:
    """(trial, finding, root, target) of findings(trial, unit, finding, path, s, e, tag) and targets(unit, target, root, path, s, e, tag) of one unit, path and tag whose closed lines meet.

    Both are dealt into cells of `width` lines and meet in the first cell they share, so a hot path is split by lines; two rows meet once. target is null where it isn't a root.
    """
    cells = lambda d: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    f, t = cells(findings).alias("f"), cells(targets.withColumn("target", F.when(F.col("root"), F.col("target")))).alias("t")
    on = [F.col(f"f.{c}") == F.col(f"t.{c}") for c in ("unit", "path", "tag", "cell")]
    met = f.join(t, on[0] & on[1] & on[2] & on[3] & (F.col("f.s") <= F.col("t.e")) & (F.col("t.s") <= F.col("f.e")))
    return met.where(F.col("f.cell") == F.floor(F.greatest("f.s", "t.s") / width)).select("trial", "finding", "root", "target")


def scored(trials: DataFrame, findings: DataFrame, roots: DataFrame, anchors: DataFrame) -> DataFrame:
    """(trial, findings, matched, detected, unlabeled, allegations) for every trial(trial, unit, role).

    A finding is matched if it hits a root or a scope anchor of its unit; detected counts distinct roots. What a positive trial finds
    beside its targets is unlabeled, and so is all that a control finds; a control's allegations are its findings on anchors. Findings meet targets in rounds of
    so many rows, and each step is summed up per trial, so scratch doesn't grow with all hits at once.
    """
    known = written(findings.join(trials.select("trial", "unit"), "trial"), "known")
    targets = roots.withColumn("root", F.lit(True)).unionByName(anchors.withColumn("root", F.lit(False)))
    rounds = -(-(known.count() + targets.count()) // ROUND) or 1
    of = lambda d, r: d.where(F.pmod(F.xxhash64("unit", "path", "tag"), F.lit(rounds)) == r)
    parts = [written(hits(of(known, r), of(targets, r)), "hits") for r in range(rounds)]
    met = reduce(DataFrame.unionByName, parts)
    by_root = written(met.where("root").select("trial", "target").distinct().groupBy("trial").agg(F.count("target").alias("detected")), "detected")
    flags = met.groupBy("trial", "finding").agg(F.max(~F.col("root")).alias("a"))
    matched = written(flags.groupBy("trial").agg(F.count(F.lit(1)).alias("matched"), F.count_if("a").alias("on_anchor")), "matched")
    discard(known, *parts)
    n = written(findings.groupBy("trial").agg(F.countDistinct("finding").alias("findings")), "findings")
    rows = trials.select("trial", "role").join(n, "trial", "left").join(matched, "trial", "left").join(by_root, "trial", "left").fillna(0, ["findings", "matched", "on_anchor", "detected"])
    positive = F.col("role") == "positive"
    return rows.select("trial", "findings", "matched", "detected", F.when(positive, F.col("findings") - F.col("matched")).otherwise(F.col("findings")).alias("unlabeled"), F.when(positive, 0).otherwise(F.col("on_anchor")).cast("long").alias("allegations"))


def trial_reasons(inventory: DataFrame, collections: DataFrame, scores: DataFrame) -> DataFrame:
    """inventory(trial, .., input_hash) with reason: the first of REASONS that holds, null for a trial that counts.

    collections(trial, valid, input_hash, output_hash): made from another input, a collection isn't bound to its trial. scores(trial, output_hash): of
    another output, a score isn't bound to its collection. trial is unique in each.
    """
    c = collections.select("trial", F.col("valid"), F.col("input_hash").alias("_in"), F.col("output_hash").alias("_out"), F.lit(True).alias("_c"))
    s = scores.select("trial", F.col("output_hash").alias("_scored"), F.lit(True).alias("_s"))
    rows = inventory.join(c, "trial", "left").join(s, "trial", "left")
    flags = [F.col("_c").isNull(), ~F.coalesce("valid", F.lit(False)), ~F.col("_in").eqNullSafe(F.col("input_hash")), F.col("_s").isNull(), ~F.col("_scored").eqNullSafe(F.col("_out"))]
    return rows.select(*inventory.columns, F.coalesce(*[F.when(f, F.lit(r)) for f, r in zip(flags, REASONS)]).alias("reason"))


def eligible_pairs(reasoned: DataFrame) -> DataFrame:
    """(pair, trials, excluded, reasons): a pair counts only if each of its trials does; reasons are the distinct ones of a pair, sorted."""
    reasons = F.array_join(F.array_sort(F.collect_set("reason")), ",")  # REASONS at most
    return reasoned.groupBy("pair").agg(F.count(F.lit(1)).alias("trials"), F.count("reason").alias("excluded"), reasons.alias("reasons"))


def run_totals(reasoned: DataFrame, scores: DataFrame) -> DataFrame:
    """(arm, trials, counted, pairs, eligible, detected, unlabeled, allegations, lead) per arm, over trials of eligible pairs; lead: detected beyond the other arms' best.

    Every trial is counted, or has one reason: trials - counted of an arm are those with a reason.
    """
    whole = eligible_pairs(reasoned).select("pair", (F.col("excluded") == 0).alias("eligible"))
    rows = reasoned.join(whole, "pair").join(scores, "trial", "left")
    of = lambda c, role: F.sum(F.when(F.col("eligible") & (F.col("role") == role), F.col(c)).otherwise(0))
    arms = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(F.col("reason").isNull()).alias("counted"), F.countDistinct("pair").alias("pairs"), F.countDistinct(F.when(F.col("eligible"), F.col("pair"))).alias("eligible"),
        of("detected", "positive").alias("detected"), of("unlabeled", "control").alias("unlabeled"), of("allegations", "control").alias("allegations"),
    )
    other = arms.select(F.col("arm").alias("_arm"), F.col("detected").alias("_detected"))
    best = arms.select("arm").join(other, F.col("arm") != F.col("_arm")).groupBy("arm").agg(F.max("_detected").alias("_best"))  # a row for each arm
    return arms.join(best, "arm", "left").withColumn("lead", F.col("detected") - F.coalesce("_best", F.lit(0))).drop("_best")
