"""Evidence closure: connected support, human acceptance, historical coverage, guards, assessments, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(claims: DataFrame, bindings: DataFrame, evidence: DataFrame, targets: DataFrame, modes: DataFrame, relations: list[str]) -> DataFrame:
    """(claim, obligation, evidence) of bindings of the given relations that connect: the binding's property is the claim's, the
    evidence is of the current snapshot and of a mode that the property accepts, and shares a target with the obligation.

    claims(claim, obligation, property, ..), bindings(claim, evidence, relation, property), evidence(evidence, mode, current,
    target), a row a target, targets(obligation, target), modes(property, mode).
    """
    c = claims.select("claim", "obligation", "property")
    rows = bindings.where(F.col("relation").isin(relations)).join(c, ["claim", "property"])
    rows = rows.join(evidence.where("current").select("evidence", "mode", "target"), "evidence").join(F.broadcast(modes), ["property", "mode"], "left_semi")  # modes: a rule table
    return rows.join(targets, ["obligation", "target"], "left_semi").select("claim", "obligation", "evidence").distinct()


def supported(claims: DataFrame, bindings: DataFrame, evidence: DataFrame, targets: DataFrame, modes: DataFrame) -> DataFrame:
    """(obligation) with a supported or accepted claim that a current, connected binding supports or reproduces."""
    some = claims.where("disposition IN ('supported', 'accepted')")
    return connected(some, bindings, evidence, targets, modes, ["supports", "reproduces"]).select("obligation").distinct()


def human_accepted(claims: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """(obligation) with an accepted claim, an accepting decision of a human reviewer on it and a finding that names this decision."""
    d = decisions.where("decision = 'accept' AND reviewer = 'human'").select("claim", "decision_id")
    chain = claims.where("disposition = 'accepted'").select("claim", "obligation").join(d, "claim")
    return chain.join(findings.select("claim", "decision_id"), ["claim", "decision_id"], "left_semi").select("obligation").distinct()


def historical(claims: DataFrame, bindings: DataFrame, verifications: DataFrame, decisions: DataFrame) -> DataFrame:
    """(claim, reproduced) whose reproducing evidence is exactly that of its passed verifications, not empty, and that was decided.

    Sets are compared by counts of a full join of distinct (claim, evidence), never as arrays.
    """
    bound = bindings.where("relation = 'reproduces'").select("claim", "evidence", F.lit(1).alias("b")).distinct()
    passed = verifications.where("passed").select("claim", "evidence", F.lit(1).alias("p")).distinct()
    sums = bound.join(passed, ["claim", "evidence"], "full_outer").groupBy("claim").agg(F.count("b").alias("b"), F.count("p").alias("p"), F.count(F.lit(1)).alias("n"))
    exact = sums.where("b = n AND p = n").select("claim", F.col("b").alias("reproduced"))
    return exact.join(claims.select("claim"), "claim", "left_semi").join(decisions.select("claim"), "claim", "left_semi")


def guard_violations(claims: DataFrame, bindings: DataFrame, evidence: DataFrame, verifications: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """(guard, claim, n): bindings to unknown evidence, verifications of unbound evidence, decisions without a passed
    verification, findings without an accepting decision; no row where a guard holds."""
    unknown = bindings.join(evidence.select("evidence").distinct(), "evidence", "left_anti").select(F.lit("binding_without_evidence").alias("guard"), "claim")
    unbound = verifications.join(bindings.select("claim", "evidence").distinct(), ["claim", "evidence"], "left_anti").select(F.lit("verification_unbound").alias("guard"), "claim")
    unverified = decisions.where("decision = 'accept'").join(verifications.where("passed").select("claim").distinct(), "claim", "left_anti").select(F.lit("decision_unverified").alias("guard"), "claim")
    undecided = findings.join(decisions.where("decision = 'accept'").select("claim", "decision_id"), ["claim", "decision_id"], "left_anti").select(F.lit("finding_undecided").alias("guard"), "claim")
    return unknown.union(unbound).union(unverified).union(undecided).groupBy("guard", "claim").agg(F.count(F.lit(1)).alias("n"))


def assessments(claims: DataFrame, bindings: DataFrame, verifications: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """(claim, evidence, verified, decisions, findings): the sorted ids that a claim's assessment closes over, joined by ','."""
    listed = lambda d, c, name: d.groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(name))
    rows = claims.select("claim")
    for d, c, name in ((bindings, "evidence", "evidence"), (verifications.where("passed"), "evidence", "verified"), (decisions, "decision_id", "decisions"), (findings, "finding_id", "findings")):
        rows = rows.join(listed(d, c, name), "claim", "left")
    return rows.select("claim", *[F.coalesce(c, F.lit("")).alias(c) for c in ("evidence", "verified", "decisions", "findings")])


def finding_status(findings: DataFrame, decisions: DataFrame, verifications: DataFrame) -> DataFrame:
    """(finding_id, status): accepted before rejected before verified before unverified."""
    d = decisions.groupBy("claim").agg(F.max(F.col("decision") == "accept").alias("a"), F.max(F.col("decision") == "reject").alias("r"))
    p = verifications.groupBy("claim").agg(F.max("passed").alias("p"))
    rows = findings.join(d, "claim", "left").join(p, "claim", "left")
    return rows.select("finding_id", F.when(F.col("a"), "accepted").when(F.col("r"), "rejected").when(F.col("p"), "verified").otherwise("unverified").alias("status"))


def dispositions(claims: DataFrame, bindings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(claim, disposition): that of the last decision that is not deferred; else contested, supported or open by its bindings."""
    last = decisions.where("decision <> 'defer'").groupBy("claim").agg(F.max_by("decision", "decision_id").alias("d"))
    b = bindings.groupBy("claim").agg(F.max(F.col("relation") == "contradicts").alias("c"), F.max(F.col("relation").isin("supports", "reproduces")).alias("s"))
    rows = claims.select("claim").join(last, "claim", "left").join(b, "claim", "left")
    told = F.when(F.col("d") == "accept", "accepted").when(F.col("d") == "reject", "rejected")
    return rows.select("claim", told.when(F.col("c"), "contested").when(F.col("s"), "supported").otherwise("open").alias("disposition"))


def unsorted_lists(rows: DataFrame, key: str, items: str) -> DataFrame:
    """(key) of rows whose array is not sorted or has an item twice; a null or empty array is sorted."""
    a = F.col(items)
    return rows.where(~(a == F.array_sort(F.array_distinct(a)))).select(key)


def outcomes(raw: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """(key, outcome, reason) of reviewers' raw output: structured, abstained, malformed or provider_failure.

    No text is a provider_failure, text that is no object of schema is malformed (empty: no JSON), an object with
    a true abstain is abstained.
    """
    t = F.trim(text)
    parsed = F.from_json(t, schema)
    return raw.select(key, F.when(F.col(text).isNull(), "provider_failure").when(t == "", "malformed").when(F.get_json_object(t, "$").isNull(), "malformed").when(parsed["abstain"], "abstained").when(parsed["verdict"].isNull(), "malformed").otherwise("structured").alias("outcome"),
                      F.when(F.col(text).isNull(), "no_output").when(t == "", "empty_output").when(F.get_json_object(t, "$").isNull(), "invalid_json").when(parsed["abstain"], "reviewer_abstained").when(parsed["verdict"].isNull(), "verdict_missing").alias("reason"))


def run_status(requested: DataFrame, executed: DataFrame, by: str, key: str) -> DataFrame:
    """(by, status): unsupported_input without a requested row, completed if executed keys are all requested ones, else in_progress."""
    rows = requested.select(by, key, F.lit(1).alias("q")).distinct().join(executed.select(by, key, F.lit(1).alias("e")).distinct(), [by, key], "full_outer")
    sums = rows.groupBy(by).agg(F.count("q").alias("q"), F.count_if(F.col("q").isNotNull() & F.col("e").isNotNull()).alias("both"))
    return sums.select(by, F.when(F.col("q") == 0, "unsupported_input").when(F.col("q") == F.col("both"), "completed").otherwise("in_progress").alias("status"))


def bundle_faults(rows: DataFrame, key: str, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, kind, n) where the number of rows of a kind is outside its bounds; rows(key, kind)."""
    counts = rows.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in bounds])
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"), F.lit(a).alias("least"), F.lit(b).alias("most")) for k, (a, b) in bounds.items()])
    return counts.select(key, F.explode(every).alias("x")).where("x.n < x.least OR x.n > x.most").select(key, "x.kind", "x.n")


def differing(told: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that only one side has, with side: told (stated but not found again) or computed (found but not stated)."""
    columns = told.columns
    return told.exceptAll(computed.select(*columns)).withColumn("side", F.lit("told")).unionByName(computed.select(*columns).exceptAll(told).withColumn("side", F.lit("computed")))
