"""Queries of the rule pack: candidates, obligations, gaps, coverage by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _CHANGED, _CLASS
from .operators import rules
from .registry import query, table

_RULES = """rule_dim(rule, rank, weight, capability) AS (VALUES ('node.changed_public_symbol@2', 0, 3.0, 'ast'), ('node.changed_public_symbol@2', 0, 3.0, 'concurrency_model'),
    ('relation.concurrent_reentry@1', 1, 3.5, 'direct_calls'), ('relation.concurrent_reentry@1', 1, 3.5, 'concurrency_model'), ('relation.changed_call_contract@1', 2, 5.0, 'direct_calls'),
    ('path.external_side_effect@1', 3, 6.0, 'direct_calls'), ('path.external_side_effect@1', 3, 6.0, 'concurrency_model'), ('path.external_side_effect@1', 3, 6.0, 'test_mapping'),
    ('invariant.payment_at_most_once@1', 4, 7.0, 'direct_calls'), ('invariant.payment_at_most_once@1', 4, 7.0, 'concurrency_model'), ('invariant.payment_at_most_once@1', 4, 7.0, 'test_mapping'),
    ('relation.changed_public_callee@1', 5, 4.0, 'ast'), ('relation.changed_public_callee@1', 5, 4.0, 'containment'), ('relation.changed_public_callee@1', 5, 4.0, 'changed_structure'),
    ('node.public_function_contract@1', 6, 3.0, 'ast'), ('node.public_function_contract@1', 6, 3.0, 'containment')),
    gap AS (SELECT rule, rank, weight, capability, coalesce(state, 'undeclared') AS state FROM rule_dim LEFT JOIN capability USING (capability) WHERE coalesce(state, 'undeclared') <> 'complete')"""
_PACK = _CHANGED + """, inv AS (SELECT DISTINCT n_regionkey AS invariant, n_nationkey AS scope FROM nation), mem AS (SELECT DISTINCT c_mktsegment || '-' || c_custkey % 20 AS path, c_nationkey AS scope FROM customer),
    nodes AS (SELECT k FROM pub WHERE is_async OR awaits OR spawns OR primitives <> 0),
    con AS (SELECT src, dst FROM external_call WHERE idempotency IS NULL AND dst IN (SELECT k FROM side_effect)), re AS (SELECT event, target FROM reentry WHERE concurrency <> 'bounded'),
    cand AS (SELECT 'node.changed_public_symbol@2' AS rule, 'node:' || k AS key, '' AS needs FROM nodes
    UNION ALL SELECT 'relation.concurrent_reentry@1', 'reentry:' || event || ':' || target, CASE WHEN target IN (SELECT k FROM nodes) THEN 'node:' || target ELSE '' END FROM re
    UNION ALL SELECT 'relation.changed_call_contract@1', 'contract:' || src || ':' || dst, '' FROM con
    UNION ALL SELECT 'path.external_side_effect@1', 'path:' || event || ':' || target || ':' || callee || ':' || dst, 'contract:' || callee || ':' || dst || ',reentry:' || event || ':' || target FROM re JOIN calls ON caller = target JOIN con ON src = callee
    UNION ALL SELECT 'invariant.payment_at_most_once@1', 'invariant:' || invariant || ':' || path, '' FROM inv JOIN mem USING (scope) GROUP BY invariant, path HAVING count(*) = (SELECT count(*) FROM inv z WHERE z.invariant = inv.invariant)), """ + _RULES
_PACK_VIEWS = ("artifact", "contains", "change", "reentry", "calls", "external_call", "side_effect", "capability")


def _candidates(spark, sf_dir, v) -> DataFrame:
    inv = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("invariant"), F.col("n_nationkey").alias("scope")).distinct()
    mem = table(spark, sf_dir, "customer").select(F.expr("concat(c_mktsegment, '-', c_custkey % 20)").alias("path"), F.col("c_nationkey").alias("scope")).distinct()
    return rules.rule_candidates(v("artifact"), v("contains"), v("change"), v("reentry"), v("calls"), v("external_call"), v("side_effect"), rules.scope_covered(inv, mem))


@query(_PACK + """ SELECT c.rule, d.rank, key, d.weight::DOUBLE AS weight, CASE WHEN g.missing IS NULL THEN 'applicable' ELSE 'unknown' END AS state, coalesce(g.missing, '') AS missing, needs
    FROM cand c JOIN (SELECT DISTINCT rule, rank, weight FROM rule_dim) d USING (rule) LEFT JOIN (SELECT rule, string_agg(capability, ',' ORDER BY capability) AS missing FROM gap GROUP BY rule) g USING (rule)""", *_PACK_VIEWS)
def rule_pack(spark, sf_dir, v):
    return rules.materialise(_candidates(spark, sf_dir, v), rules.rule_table(spark), v("capability"))


@query(_PACK + """ SELECT rule, capability, 'capability_' || state AS reason, weight::DOUBLE AS weight,
    CASE state WHEN 'partial' THEN 'incomplete_extraction' WHEN 'missing' THEN 'missing_extraction' WHEN 'unknown' THEN 'unknown_extraction' ELSE 'undeclared_extraction' END AS kind, 'Capability ' || capability || ' is ' || state AS title,
    'obligation:sha256:' || sha256('capability_gap.origin_rule@1|' || rule || '|' || capability) AS id FROM gap WHERE rule IN (SELECT rule FROM cand)""", *_PACK_VIEWS)
def gap_obligations(spark, sf_dir, v):
    return rules.gap_obligations(_candidates(spark, sf_dir, v), rules.rule_table(spark), v("capability"))


@query(_PACK + " SELECT rule, count(*) AS obligations, count(*) FILTER (needs <> '') AS dependent FROM cand GROUP BY rule", *_PACK_VIEWS)
def obligations_by_rule(spark, sf_dir, v):
    return _candidates(spark, sf_dir, v).groupBy("rule").agg(F.count(F.lit(1)).alias("obligations"), F.count_if(F.size("needs") > 0).alias("dependent"))


_PUBLIC = f"""own AS (SELECT member, count(*) AS n, min(container) AS module FROM module_edge GROUP BY member),
    fn AS (SELECT k, CASE WHEN n = 1 THEN module END AS module, CASE WHEN {_CLASS.format('path')} <> 'production' THEN 'path_' || {_CLASS.format('path')} WHEN n IS NULL THEN 'owner_missing' WHEN n > 1 THEN 'owner_ambiguous' ELSE 'obligation' END AS outcome
    FROM artifact LEFT JOIN own ON member = k WHERE public)"""


@query("+" + _PUBLIC + " SELECT * FROM fn", "artifact", "module_edge")
def public_function_obligations(spark, sf_dir, v):
    return rules.public_functions(v("artifact"), v("module_edge"))


@query(_CHANGED + f""", x AS (SELECT c.caller, c.callee, c.resolution FROM calls c JOIN pub p ON p.k = c.callee JOIN artifact a ON a.k = c.caller
    WHERE c.caller <> c.callee AND {_CLASS.format('p.path')} = 'production' AND {_CLASS.format('a.path')} = 'production')
    SELECT CASE resolution WHEN 'syntactic_unique' THEN 'resolved' ELSE 'candidate_gap' END AS layer, count(*) AS members, count(DISTINCT callee) AS callees,
    (SELECT coalesce(max(state), 'undeclared') FROM capability WHERE capability = 'direct_calls') AS state FROM x GROUP BY 1""", "artifact", "contains", "change", "calls", "capability")
def two_layer_coverage(spark, sf_dir, v):
    return rules.two_layers(rules.changed_callee(v("artifact"), v("contains"), v("change"), v("calls")), v("capability"), "direct_calls")


@query(_CHANGED + ", " + _PUBLIC + f""", u AS (SELECT 'public' AS rule, k, outcome FROM fn UNION ALL SELECT 'changed', k, CASE WHEN {_CLASS.format('path')} = 'production' THEN 'obligation' ELSE 'excluded' END FROM pub)
    SELECT rule, count(*) AS total, count(*) FILTER (outcome = 'obligation' AND k IN (SELECT k FROM planned)) AS planned, count(*) FILTER (outcome = 'obligation' AND k NOT IN (SELECT k FROM planned)) AS unplanned,
    count(*) FILTER (outcome <> 'obligation') AS excluded FROM u GROUP BY rule""", "artifact", "contains", "change", "module_edge", "planned")
def rule_plan_coverage(spark, sf_dir, v):
    from .functions.scalar import path_class

    public = rules.public_functions(v("artifact"), v("module_edge")).select(F.lit("public").alias("rule"), "k", "outcome")
    changed = rules.changed_public(v("artifact"), v("contains"), v("change"))
    changed = changed.select(F.lit("changed").alias("rule"), "k", F.when(path_class(F.col("path")) == "production", "obligation").otherwise("excluded").alias("outcome"))
    return rules.rule_coverage(public.unionByName(changed), v("planned"))


@query(_CHANGED + """, u AS (SELECT 'public' AS rule, label || '@' || path AS key FROM artifact WHERE public UNION ALL SELECT 'changed', label || '@' || path FROM pub)
    SELECT key, count(*) AS n, count(DISTINCT rule) AS rules FROM u GROUP BY key HAVING count(*) > 1""", "artifact", "contains", "change")
def obligation_collisions(spark, sf_dir, v):
    named = lambda d, rule: d.select(F.lit(rule).alias("rule"), F.concat("label", F.lit("@"), "path").alias("key"))
    return rules.collisions(named(v("artifact").where("public"), "public").union(named(rules.changed_public(v("artifact"), v("contains"), v("change")), "changed")), "key")


@query("""+b AS (SELECT substr(sha256(id), 1, 3) AS bucket, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS d FROM obligation GROUP BY 1)
    SELECT sum(n)::BIGINT AS members, sha256(string_agg(d, ',' ORDER BY bucket)) AS identity FROM b""", "obligation")
def universe_identity(spark, sf_dir, v):
    return rules.universe_digest(v("obligation"), "id")
