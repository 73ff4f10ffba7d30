"""The chain from an execution to a finding, closed hop by hop, with sets compared by mergeable fingerprints; qualifications of sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hops, first to last.
HOPS = ("execution", "binding", "verification", "assessment", "assessed_verifications", "decision", "finding")


def set_equality(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """(key, left, right, equal) for every key of either side: sizes of the two sets of members, and whether they are the same.

    One aggregation over both: counts, and for each side an exclusive or and a sum of two 64-bit hashes of the members, so a key of any number of
    members is summed before the shuffle. Unequal sets of a size pass for equal with odds of one in 2**100 or so.
    """
    side = lambda d, name: d.select(F.col(key).alias("key"), F.col(member).cast("string").alias("m")).distinct().withColumn("side", F.lit(name))
    both = side(left, "left").unionByName(side(right, "right"))

    def prints(name: str) -> list[Column]:
        own = F.col("side") == name
        x, s = F.when(own, F.xxhash64("m")).otherwise(0), F.when(own, F.xxhash64(F.lit("sum"), "m")).otherwise(0)
        return [F.count_if(own).alias(name), F.bit_xor(x).alias(f"{name}_x"), F.sum(s.cast("decimal(20,0)")).alias(f"{name}_s")]

    sums = both.groupBy("key").agg(*prints("left"), *prints("right"))
    equal = (F.col("left") == F.col("right")) & (F.col("left_x") == F.col("right_x")) & (F.col("left_s") == F.col("right_s"))
    return sums.select(F.col("key").alias(key), "left", "right", equal.alias("equal"))


def closed_chain(claims: DataFrame, parsed: DataFrame, bindings: DataFrame, evidence: DataFrame, verifications: DataFrame, assessed: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """(claim, broken): every claim with the first hop of HOPS that doesn't hold, null where all do.

    claims(claim, execution), parsed(execution, claim), bindings(claim, evidence, relation), evidence(evidence), verifications(claim, evidence, passed),
    assessed(claim, kind `verification`, `decision` or `finding`, member), decisions(claim, decision_id, decision), findings(claim, finding_id, decision_id).
    execution: what it parsed is exactly the claims that name it. binding: all evidence is known, some reproduces. verification: the reproducing
    evidence is exactly that of passed verifications. assessment: there is one. Then its lists are exactly the verifications, the decisions
    (one or more) and the findings (none names a decision that is not an accepting one of the claim).
    """
    equal = lambda d, name: d.where("equal").select(*[c for c in d.columns if c not in ("left", "right", "equal")], F.lit(True).alias(name))
    whole = equal(set_equality(claims, parsed, "execution", "claim"), "execution_ok")
    unknown = bindings.join(evidence.select("evidence").distinct(), "evidence", "left_anti").select("claim").distinct().withColumn("stray", F.lit(True))
    proof = set_equality(bindings.where("relation = 'reproduces'"), verifications.where("passed"), "claim", "evidence").select("claim", F.col("left").alias("reproduced"), F.col("equal").alias("proved"))
    listed = lambda kind: assessed.where(F.col("kind") == kind)
    told = lambda kind, rows, column: set_equality(listed(kind), rows.select("claim", F.col(column).alias("member")), "claim", "member").select("claim", F.col("right").alias(f"n_{kind}"), F.col("equal").alias(f"{kind}_ok"))
    accepted = decisions.where("decision = 'accept'").select("claim", "decision_id")
    loose = findings.join(accepted, ["claim", "decision_id"], "left_anti").select("claim").distinct().withColumn("loose", F.lit(True))
    has = assessed.select("claim").distinct().withColumn("assessed", F.lit(True))
    tables = [unknown, proof, has, told("verification", verifications, "evidence"), told("decision", decisions, "decision_id"), told("finding", findings, "finding_id"), loose]
    rows = reduce(lambda a, b: a.join(b, "claim", "left"), tables, claims.select("claim", "execution").join(whole, "execution", "left"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    absent = lambda c: F.coalesce(F.col(c), F.lit(True))  # noqa: E731  both sets are empty
    holds = [yes("execution_ok"), ~yes("stray") & (F.coalesce("reproduced", F.lit(0)) > 0), yes("proved"), yes("assessed"), absent("verification_ok"), yes("decision_ok") & (F.coalesce("n_decision", F.lit(0)) > 0), absent("finding_ok") & ~yes("loose")]
    return rows.select("claim", F.coalesce(*[F.when(~h, F.lit(name)) for name, h in zip(HOPS, holds)]).alias("broken"))


def qualification_faults(descriptors: DataFrame, domain: DataFrame, sections: DataFrame, parts: DataFrame) -> DataFrame:
    """(context, qualification): sources of descriptors(context, qualification) that lie outside their context's closure.

    The closure is the cover's domain(id) and what the context's section holds: sections(context, section), parts(section, part) being bindings,
    evidence, verifications, decisions and findings alike. Parts that are sections or bundles themselves hold their own parts in turn: followed
    until none is new, cycles end.
    """
    from ..plans.graph import spread

    reach = sections.select("context", F.col("section").cast("string").alias("part"))
    step = lambda front: front.join(parts.select(F.col("section").cast("string").alias("part"), F.col("part").cast("string").alias("_next")), "part").select("context", F.col("_next").alias("part"))
    held = spread(reach, step, ["context", "part"]).select("context", F.col("part").alias("qualification"))
    asked = descriptors.select("context", F.col("qualification").cast("string").alias("qualification")).distinct()
    return asked.join(domain.select(F.col("id").cast("string").alias("qualification")).distinct(), "qualification", "left_anti").join(held, ["context", "qualification"], "left_anti")
