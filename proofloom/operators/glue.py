"""Gluing of sections over overlapping contexts, and family decisions: first matching row of a decision table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cover(declared: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, status) of declared ids: covered if known, else uncovered."""
    return declared.select(key).distinct().join(known.select(key, F.lit(True).alias("_k")).distinct(), key, "left").select(key, F.when(F.col("_k"), "covered").otherwise("uncovered").alias("status"))


def glue(sections: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(pair, result, obstruction) per pair.

    sections(pair, assignment, verified, qualified), overlaps(pair): pairs whose overlap anchor is there.
    Not two sections, no anchor or an unknown assignment: unknown; differing assignments: failed; one not verified:
    candidate; with qualifications: glued_with_qualification; else glued.
    """
    rows = sections.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("assignment").alias("values"), F.max(F.col("assignment") == "unknown").alias("open"), F.min("verified").alias("verified"), F.max("qualified").alias("qualified"))
    rows = rows.join(overlaps.select("pair", F.lit(True).alias("anchor")).distinct(), "pair", "left")
    why = F.when(F.col("n") != 2, "required_section_missing").when(F.col("anchor").isNull(), "required_overlap_missing").when(F.col("open"), "section_unknown").when(F.col("values") > 1, "assignment_conflict")
    result = F.when(why == "assignment_conflict", "failed").when(why.isNotNull(), "unknown").when(~F.col("verified"), "candidate").when(F.col("qualified"), "glued_with_qualification").otherwise("glued")
    return rows.select("pair", result.alias("result"), why.alias("obstruction"))


def family_decision(assessed: DataFrame) -> DataFrame:
    """(candidate, decision) from rows (candidate, property, verdict), a row per member and property.

    shared_validator: contracts and safety supported by all; shared_conformance_test: contracts alone;
    intentional_separation: a separation is supported and some contract opposes it; else inconclusive.
    """
    all_of = lambda p: F.coalesce(F.min(F.when(F.col("property") == p, F.col("verdict") == "supports")), F.lit(False))
    any_of = lambda p, v: F.coalesce(F.max(F.when(F.col("property") == p, F.col("verdict") == v)), F.lit(False))
    rows = assessed.groupBy("candidate").agg(all_of("contract").alias("contract"), all_of("safety").alias("safety"), any_of("separation", "supports").alias("apart"), any_of("contract", "opposes").alias("opposed"))
    decision = F.when(F.col("apart") & F.col("opposed"), "intentional_separation").when(~F.col("apart") & F.col("contract") & F.col("safety"), "shared_validator").when(~F.col("apart") & F.col("contract"), "shared_conformance_test")
    return rows.select("candidate", decision.otherwise("inconclusive").alias("decision"))
