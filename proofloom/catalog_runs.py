"""Queries of runs: enumerate and defer with exact accounting, the lifecycle as a stateful stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import enumerate as enumeration
from .registry import query, table
from .streaming import stateful

_RULES = ["callee_contract", "public_function", "write_validation"]
_REASON = "CASE WHEN p_partkey % 31 = 1 THEN 'vendor_path' WHEN p_size % 7 = 0 THEN 'unsupported_node' WHEN p_partkey % 31 = 3 THEN 'test_path' END"

_RUN = f"""WITH e AS (SELECT sha256(concat(rule, '|', 'node:', p_partkey)) AS id, concat('node:', p_partkey) AS node, p_brand AS key, {_REASON} AS reason, rule FROM part, (VALUES {', '.join(f"('{r}')" for r in _RULES)}) r(rule)),
    o AS (SELECT *, row_number() OVER (ORDER BY key, node, rule) AS place FROM e WHERE reason IS NULL), b AS (SELECT count(*) // 2 AS most FROM part),
    run AS (SELECT id, node, rule, CASE WHEN place > (SELECT most FROM b) THEN 'deferred' ELSE 'admitted' END AS part, place, CASE WHEN place > (SELECT most FROM b) THEN 'budget_exhausted' END AS reason FROM o
      UNION ALL SELECT id, node, rule, 'excluded', NULL, reason FROM e WHERE reason IS NOT NULL)"""


def _run(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    nodes = parts.select(F.concat(F.lit("node:"), "p_partkey").alias("node"), F.col("p_brand").alias("key"), F.expr(_REASON).alias("_reason"))
    return enumeration.enumerated(nodes, _RULES, F.col("_reason"), parts.count() // 2)


@query(_RUN + " SELECT * FROM run")
def enumerate_and_defer(spark, sf_dir, v):
    return _run(spark, sf_dir)


@query(_RUN + """, k AS (SELECT CASE WHEN count(*) <= 16384 THEN 1 WHEN count(*) <= 262144 THEN 2 WHEN count(*) <= 4194304 THEN 3 ELSE 4 END AS digits FROM run),
    d AS (SELECT part, substr(id, 1, (SELECT digits FROM k)) AS b, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS d FROM run GROUP BY 1, 2),
    p AS (SELECT part, sum(n)::BIGINT AS n, sha256(string_agg(d, ',' ORDER BY b)) AS ids FROM d GROUP BY 1) SELECT x.part, coalesce(n, 0) AS n, coalesce(ids, sha256('')) AS ids FROM (VALUES ('admitted'), ('deferred'), ('excluded')) x(part) LEFT JOIN p USING (part)""")
def enumeration_accounting(spark, sf_dir, v):
    return enumeration.accounting(_run(spark, sf_dir))


@query(_RUN + """ SELECT id, 'missing' AS fault FROM run WHERE place % 97 = 5 UNION ALL SELECT id, 'repeated' FROM run WHERE place % 97 = 6 UNION ALL SELECT concat('x', id), 'undeclared' FROM run WHERE place % 97 = 7""")
def enumeration_faults(spark, sf_dir, v):
    """Planted: some obligations are in no part, some in two, some parts have ids that no rule gave."""
    run = _run(spark, sf_dir)
    planted = run.where("place IS NULL OR place % 97 <> 5").select("id").unionByName(run.where("place % 97 = 6").select("id")).unionByName(run.where("place % 97 = 7").select(F.concat(F.lit("x"), "id").alias("id")))
    return enumeration.cover_faults(run, planted)


@query("""+l AS (SELECT stream, seq, lag(state) OVER (PARTITION BY stream ORDER BY seq) AS before, state FROM event), ok(b, s) AS (VALUES ('generated', 'planned'), ('planned', 'in_progress'), ('in_progress', 'completed'), ('generated', 'stale'),
    ('generated', 'superseded'), ('generated', 'cancelled'), ('planned', 'stale'), ('planned', 'superseded'), ('planned', 'cancelled'), ('in_progress', 'stale'), ('in_progress', 'superseded'), ('in_progress', 'cancelled'), ('completed', 'stale'), ('completed', 'superseded'))
    SELECT stream, seq, before, state, CASE WHEN before IS NULL THEN 'first' WHEN (before, state) IN (SELECT b, s FROM ok) THEN 'legal' ELSE 'illegal' END AS outcome FROM l""", "event")
def lifecycle_stream(spark, sf_dir, v):
    """The events table read as a stream."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    state = F.expr("CASE event_type WHEN 'signup' THEN 'generated' WHEN 'view' THEN 'planned' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' ELSE 'stale' END")
    return stateful.run(spark, raw.select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), state.alias("state")))
