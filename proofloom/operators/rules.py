"""Obligation rules: changed symbols, calls, paths, invariants and capability gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import path_class
from ..model import RULES, stable_id


def rule_table(spark) -> DataFrame:
    rows = [(*r, i) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule string, target_kind string, property string, weight double, required array<string>, rank int")


def capability_gaps(rules: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(rule, capability, reason) for required capabilities that are not complete; undeclared ones count."""
    need = rules.select("rule", F.explode("required").alias("capability")).join(capabilities, "capability", "left")
    state = F.coalesce("state", F.lit("undeclared"))
    return need.where(state != "complete").select("rule", "capability", F.concat(F.lit("capability_"), state).alias("reason"))


def changed_public(artifacts: DataFrame, contains: DataFrame, changes: DataFrame) -> DataFrame:
    """Public artifacts that changed themselves or lie in a changed container, with the number of containers that witness it."""
    inside = contains.join(changes.select(F.col("k").alias("container")), "container", "left_semi")
    witness = inside.groupBy(F.col("member").alias("k")).agg(F.count(F.lit(1)).alias("witnesses"))
    rows = artifacts.where("public").join(witness, "k", "left").where("own_change OR witnesses IS NOT NULL")
    return rows.withColumn("witnesses", F.coalesce("witnesses", F.lit(0)))


def changed_callee(artifacts: DataFrame, contains: DataFrame, changes: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per call whose callee is public and changed: exclusion by path class (callee first), obstruction if the call is not uniquely resolved, or obligation."""
    callee = changed_public(artifacts, contains, changes).select(F.col("k").alias("callee"), F.col("path").alias("callee_path"), "witnesses")
    caller = artifacts.select(F.col("k").alias("caller"), F.col("path").alias("caller_path"))
    rows = calls.where("caller <> callee").join(callee, "callee").join(caller, "caller")
    a, b = path_class(F.col("callee_path")), path_class(F.col("caller_path"))
    outcome = F.when(a != "production", F.concat(F.lit("callee_"), a)).when(b != "production", F.concat(F.lit("caller_"), b))
    outcome = outcome.when(F.col("resolution") != "syntactic_unique", F.concat(F.lit("obstruction_"), F.col("resolution"))).otherwise("obligation")
    return rows.select("caller", "callee", "witnesses", outcome.alias("outcome"), stable_id("obligation", F.lit("relation.changed_public_callee@1"), F.col("caller"), F.col("callee")).alias("id"))


def contract_calls(calls: DataFrame, side_effects: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Calls to artifacts with external side effects that have no idempotency key."""
    calls = calls.where("idempotency IS NULL")
    return calls.join(side_effects.select(F.col("k").alias(dst)), dst, "left_semi").select(src, dst)


def effect_paths(handled: DataFrame, contains: DataFrame, calls: DataFrame) -> DataFrame:
    """Three ordered hops: event, handler, callee, external effect."""
    first = handled.select(F.col("src").alias("event"), F.col("dst").alias("handler"))
    second = contains.select(F.col("container").alias("handler"), F.col("member").alias("callee"))
    third = calls.select(F.col("src").alias("callee"), F.col("dst").alias("effect"))
    return first.join(second, "handler").join(third, "callee").select("event", "handler", "callee", "effect")


def scope_covered(invariants: DataFrame, members: DataFrame) -> DataFrame:
    """(invariant, path) where every scope of the invariant is among the contexts of the path: a division by counts.

    invariants(invariant, scope), members(path, scope), both distinct.
    """
    size = invariants.groupBy("invariant").agg(F.count(F.lit(1)).alias("n"))
    met = invariants.join(members, "scope").groupBy("invariant", "path").agg(F.count(F.lit(1)).alias("m"))
    return met.join(size, "invariant").where("m = n").select("invariant", "path")


def local_concurrency(rows: DataFrame) -> DataFrame:
    """Artifacts with evidence of concurrency of their own: async, awaits, spawns or a primitive."""
    return rows.where("is_async OR awaits OR spawns OR primitives > 0")


def rule_candidates(artifacts: DataFrame, contains: DataFrame, changes: DataFrame, reentry: DataFrame, calls: DataFrame, external: DataFrame, effects: DataFrame, scoped: DataFrame) -> DataFrame:
    """(rule, key, needs) of the node, re-entry, contract, path and invariant rules; needs: keys of the obligations it depends on, sorted.

    Every rule's keys are distinct. A re-entry needs the node obligation of its target if there is one, a path its re-entry and
    its contract, an invariant nothing beyond its path key.
    """
    none = F.array().cast("array<string>")
    key = lambda kind, *c: F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in c])
    nodes = local_concurrency(changed_public(artifacts, contains, changes)).select(F.col("k").alias("target"), key("node", "k").alias("node"))
    open_ = reentry.where("concurrency = 'unbounded_reentry'").select("event", "target")
    relations = open_.join(nodes, "target", "left").select(key("reentry", "event", "target").alias("key"), F.array_compact(F.array("node")).alias("needs"))
    contracts = contract_calls(external, effects)
    hops = open_.join(calls.select(F.col("caller").alias("target"), "callee"), "target").join(contracts.select(F.col("src").alias("callee"), F.col("dst").alias("effect")), "callee")
    paths = hops.select(key("path", "event", "target", "callee", "effect").alias("key"), F.array(key("contract", "callee", "effect"), key("reentry", "event", "target")).alias("needs"))
    rows = [
        ("node.changed_public_symbol@2", nodes.select(F.col("node").alias("key"), none.alias("needs"))),
        ("relation.concurrent_reentry@1", relations),
        ("relation.changed_call_contract@1", contracts.select(key("contract", "src", "dst").alias("key"), none.alias("needs"))),
        ("path.external_side_effect@1", paths),
        ("invariant.payment_at_most_once@1", scoped.select(key("invariant", "invariant", "path").alias("key"), none.alias("needs"))),
    ]
    out = None
    for rule, found in rows:
        found = found.select(F.lit(rule).alias("rule"), "key", "needs")
        out = found if out is None else out.unionByName(found)
    return out


def materialise(candidates: DataFrame, rules: DataFrame, capabilities: DataFrame) -> DataFrame:
    """candidates with weight, the rule's rank, state and missing: applicable, or unknown where a required capability is not complete."""
    gaps = capability_gaps(rules, capabilities).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_set("capability")), ",").alias("missing"))
    dim = rules.join(gaps, "rule", "left").select("rule", "rank", "weight", F.coalesce("missing", F.lit("")).alias("missing"))
    rows = candidates.join(F.broadcast(dim), "rule")
    return rows.select("rule", "rank", "key", "weight", F.when(F.col("missing") == "", "applicable").otherwise("unknown").alias("state"), "missing", F.array_join("needs", ",").alias("needs"))


def gap_obligations(candidates: DataFrame, rules: DataFrame, capabilities: DataFrame) -> DataFrame:
    """One obligation for each missing capability of each rule that had a candidate, with kind and title."""
    gaps = capability_gaps(rules, capabilities).join(candidates.select("rule").distinct(), "rule", "left_semi").join(rules.select("rule", "weight"), "rule")
    state = F.substring_index("reason", "_", -1)
    kind = F.when(state == "partial", "incomplete_extraction").when(state == "missing", "missing_extraction").when(state == "unknown", "unknown_extraction").otherwise("undeclared_extraction")
    title = F.concat(F.lit("Capability "), F.col("capability"), F.lit(" is "), state)
    return gaps.select("rule", "capability", "reason", "weight", kind.alias("kind"), title.alias("title"), stable_id("obligation", F.lit("capability_gap.origin_rule@1"), F.col("rule"), F.col("capability")).alias("id"))


def public_functions(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, module, outcome) of public functions: obligation with its one owning module, or exclusion by path, or for no or several owners."""
    owners = edges.groupBy(F.col("member").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("container").alias("module"))
    rows = artifacts.where("public").join(owners, "k", "left")
    kind = path_class(F.col("path"))
    outcome = F.when(kind != "production", F.concat(F.lit("path_"), kind)).when(F.col("n").isNull(), "owner_missing").when(F.col("n") > 1, "owner_ambiguous").otherwise("obligation")
    return rows.select("k", F.when(F.col("n") == 1, F.col("module")).alias("module"), outcome.alias("outcome"))


def two_layers(found: DataFrame, capabilities: DataFrame, needed: str) -> DataFrame:
    """(layer, members, callees, state) of the outcomes of changed_callee(): resolved obligations, and candidates behind obstructions; state: the needed capability's."""
    layer = F.when(F.col("outcome") == "obligation", "resolved").when(F.col("outcome").startswith("obstruction_"), "candidate_gap")
    sums = found.select(layer.alias("layer"), "callee").where("layer IS NOT NULL").groupBy("layer").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("callee").alias("callees"))
    state = capabilities.where(F.col("capability") == needed).agg(F.coalesce(F.max("state"), F.lit("undeclared")).alias("state"))
    return sums.crossJoin(F.broadcast(state))  # one row


def rule_coverage(universe: DataFrame, plan: DataFrame) -> DataFrame:
    """(rule, total, planned, unplanned, excluded) of rows (rule, k, outcome); planned are obligations in plan(k)."""
    rows = universe.join(plan.select("k", F.lit(True).alias("p")).distinct(), "k", "left")
    open_ = F.col("outcome") == "obligation"
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("total"), F.count_if(open_ & F.col("p").isNotNull()).alias("planned"), F.count_if(open_ & F.col("p").isNull()).alias("unplanned"), F.count_if(~open_).alias("excluded"))


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, rules): keys that more than one rule made, or one rule more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule").alias("rules")).where("n > 1")


def universe_digest(rows: DataFrame, key: str) -> DataFrame:
    """One row (members, identity): a digest of the sorted digests of 4,096 buckets of ids, so that no task holds all ids."""
    bucket = F.substring(F.sha2(F.col(key), 256), 1, 3)
    parts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(key)), ","), 256).alias("d"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ",")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.sha2(every, 256).alias("identity"))
