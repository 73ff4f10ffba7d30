"""Queries of the evidence closure and of the callables of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import callables, closure
from .registry import query, table

_MODES = [("p0", "source_inspection"), ("p0", "test"), ("p1", "static_fact"), ("p1", "test"), ("p2", "test"), ("p3", "source_inspection"), ("p3", "static_fact"), ("p3", "test")]
_MODE_SQL = "modes(property, mode) AS (VALUES ('p0', 'source_inspection'), ('p0', 'test'), ('p1', 'static_fact'), ('p1', 'test'), ('p2', 'test'), ('p3', 'source_inspection'), ('p3', 'static_fact'), ('p3', 'test'))"
_SUPPORTED = f"""+{_MODE_SQL}, sup AS (SELECT DISTINCT obligation FROM claim c WHERE disposition <> 'open' AND EXISTS (SELECT 1 FROM bound b JOIN evid e USING (evidence) JOIN modes m ON m.property = b.property AND m.mode = e.mode
    JOIN obl_target t ON t.target = e.target WHERE b.claim = c.claim AND b.property = c.property AND b.relation <> 'contradicts' AND e.current AND t.obligation = c.obligation))"""


@query(_SUPPORTED + " SELECT * FROM sup", "claim", "bound", "evid", "obl_target")
def connected_support(spark, sf_dir, v):
    return closure.supported(v("claim"), v("bound"), v("evid"), v("obl_target"), spark.createDataFrame(_MODES, "property string, mode string"))


_ACCEPTED = """acc AS (SELECT DISTINCT obligation FROM claim c JOIN verdict d USING (claim) WHERE disposition = 'accepted' AND decision = 'accept' AND reviewer = 'human'
    AND EXISTS (SELECT 1 FROM fnd f WHERE f.claim = c.claim AND f.decision_id = d.decision_id))"""


@query("+" + _ACCEPTED + " SELECT * FROM acc", "claim", "verdict", "fnd")
def human_acceptance(spark, sf_dir, v):
    return closure.human_accepted(v("claim"), v("verdict"), v("fnd"))


@query(_SUPPORTED + ", " + _ACCEPTED + """, o AS (SELECT DISTINCT obligation FROM claim) SELECT axis, count(*) FILTER (q) AS qualified, count(*) AS denominator, round(count(*) FILTER (q) / count(*)::DOUBLE, 6) AS ratio
    FROM (SELECT unnest(['evidence_supported', 'human_accepted']) AS axis, unnest([obligation IN (SELECT obligation FROM sup), obligation IN (SELECT obligation FROM acc)]) AS q FROM o) GROUP BY axis""", "claim", "bound", "evid", "obl_target", "verdict", "fnd")
def closure_axes(spark, sf_dir, v):
    every = v("claim").select("obligation").distinct()
    mark = lambda d, c: d.select("obligation", F.lit(True).alias(c))
    supported = closure.supported(v("claim"), v("bound"), v("evid"), v("obl_target"), spark.createDataFrame(_MODES, "property string, mode string"))
    rows = every.join(mark(supported, "s"), "obligation", "left").join(mark(closure.human_accepted(v("claim"), v("verdict"), v("fnd")), "h"), "obligation", "left")
    long = rows.select(F.explode(F.array(F.struct(F.lit("evidence_supported").alias("axis"), F.col("s").isNotNull().alias("q")), F.struct(F.lit("human_accepted").alias("axis"), F.col("h").isNotNull().alias("q")))).alias("x"))
    sums = long.groupBy("x.axis").agg(F.count_if("x.q").alias("qualified"), F.count(F.lit(1)).alias("denominator"))
    return sums.withColumn("ratio", F.when(F.col("denominator") == 0, F.lit(0.0)).otherwise(F.round(F.col("qualified") / F.col("denominator"), 6)))


@query("""+b AS (SELECT claim, list_sort(list(DISTINCT evidence)) AS l FROM bound WHERE relation = 'reproduces' GROUP BY claim), p AS (SELECT claim, list_sort(list(DISTINCT evidence)) AS l FROM verif WHERE passed GROUP BY claim)
    SELECT claim, len(b.l)::BIGINT AS reproduced FROM b JOIN p USING (claim) WHERE b.l = p.l AND claim IN (SELECT claim FROM claim) AND claim IN (SELECT claim FROM verdict)""", "claim", "bound", "verif", "verdict")
def historical_closure(spark, sf_dir, v):
    return closure.historical(v("claim"), v("bound"), v("verif"), v("verdict"))


@query("""SELECT guard, claim, count(*) AS n FROM (SELECT 'binding_without_evidence' AS guard, claim FROM bound WHERE evidence NOT IN (SELECT evidence FROM evid)
    UNION ALL SELECT 'verification_unbound', claim FROM verif x WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.claim = x.claim AND b.evidence = x.evidence)
    UNION ALL SELECT 'decision_unverified', claim FROM verdict WHERE decision = 'accept' AND claim NOT IN (SELECT claim FROM verif WHERE passed)
    UNION ALL SELECT 'finding_undecided', claim FROM fnd f WHERE NOT EXISTS (SELECT 1 FROM verdict d WHERE d.claim = f.claim AND d.decision_id = f.decision_id AND decision = 'accept')) GROUP BY ALL""", "claim", "bound", "evid", "verif", "verdict", "fnd")
def guard_violations(spark, sf_dir, v):
    return closure.guard_violations(v("claim"), v("bound"), v("evid"), v("verif"), v("verdict"), v("fnd"))


@query("""SELECT claim, coalesce((SELECT string_agg(DISTINCT evidence::VARCHAR, ',' ORDER BY evidence::VARCHAR) FROM bound b WHERE b.claim = c.claim), '') AS evidence,
    coalesce((SELECT string_agg(DISTINCT evidence::VARCHAR, ',' ORDER BY evidence::VARCHAR) FROM verif b WHERE b.claim = c.claim AND passed), '') AS verified,
    coalesce((SELECT string_agg(DISTINCT decision_id::VARCHAR, ',' ORDER BY decision_id::VARCHAR) FROM verdict b WHERE b.claim = c.claim), '') AS decisions,
    coalesce((SELECT string_agg(DISTINCT finding_id::VARCHAR, ',' ORDER BY finding_id::VARCHAR) FROM fnd b WHERE b.claim = c.claim), '') AS findings FROM claim c""", "claim", "bound", "verif", "verdict", "fnd")
def claim_assessments(spark, sf_dir, v):
    return closure.assessments(v("claim"), v("bound"), v("verif"), v("verdict"), v("fnd"))


@query("""SELECT finding_id, CASE WHEN claim IN (SELECT claim FROM verdict WHERE decision = 'accept') THEN 'accepted' WHEN claim IN (SELECT claim FROM verdict WHERE decision = 'reject') THEN 'rejected'
    WHEN claim IN (SELECT claim FROM verif WHERE passed) THEN 'verified' ELSE 'unverified' END AS status FROM fnd""", "verdict", "verif", "fnd")
def finding_status(spark, sf_dir, v):
    return closure.finding_status(v("fnd"), v("verdict"), v("verif"))


@query("""+d AS (SELECT claim, arg_max(decision, decision_id) AS d FROM verdict WHERE decision <> 'defer' GROUP BY claim)
    SELECT claim, CASE WHEN d = 'accept' THEN 'accepted' WHEN d = 'reject' THEN 'rejected' WHEN claim IN (SELECT claim FROM bound WHERE relation = 'contradicts') THEN 'contested' WHEN claim IN (SELECT claim FROM bound) THEN 'supported' ELSE 'open' END AS disposition
    FROM claim LEFT JOIN d USING (claim)""", "claim", "bound", "verdict")
def claim_dispositions(spark, sf_dir, v):
    return closure.dispositions(v("claim"), v("bound"), v("verdict"))


@query("SELECT k FROM artifact WHERE string_split(label, ' ') <> list_sort(list_distinct(string_split(label, ' ')))", "artifact")
def unsorted_members(spark, sf_dir, v):
    return closure.unsorted_lists(v("artifact").withColumn("items", F.split("label", " ")), "k", "items")


_RAW = """CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '{"verdict": "ok", "abstain": false}' WHEN 3 THEN '{"abstain": true}' WHEN 4 THEN 'not json {' WHEN 5 THEN '{"verdict": "bad"}' ELSE '{"other": 1}' END"""


@query(f"""WITH r AS (SELECT event_id AS id, {_RAW} AS raw FROM events), j AS (SELECT id, raw, CASE WHEN json_valid(raw) AND trim(raw) <> '' THEN raw::JSON END AS o FROM r)
    SELECT id, CASE WHEN raw IS NULL THEN 'provider_failure' WHEN o IS NULL THEN 'malformed' WHEN o->>'abstain' = 'true' THEN 'abstained' WHEN o->>'verdict' IS NULL THEN 'malformed' ELSE 'structured' END AS outcome,
    CASE WHEN raw IS NULL THEN 'no_output' WHEN trim(raw) = '' THEN 'empty_output' WHEN o IS NULL THEN 'invalid_json' WHEN o->>'abstain' = 'true' THEN 'reviewer_abstained' WHEN o->>'verdict' IS NULL THEN 'verdict_missing' END AS reason FROM j""")
def reviewer_outcomes(spark, sf_dir, v):
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_RAW).alias("raw"))
    return closure.outcomes(raw, "id", "raw", "verdict string, abstain boolean")


@query("""SELECT stream, CASE WHEN count(*) FILTER (q) = 0 THEN 'unsupported_input' WHEN count(*) FILTER (q) = count(*) FILTER (q AND e) THEN 'completed' ELSE 'in_progress' END AS status FROM
    (SELECT stream, k, bool_or(q) AS q, bool_or(e) AS e FROM (SELECT stream, k, true AS q, false AS e FROM obligation WHERE status <> 'P' UNION ALL SELECT stream, k, false, true FROM obligation WHERE k IN (SELECT claim FROM verif WHERE passed)) GROUP BY stream, k) GROUP BY stream""", "obligation", "verif")
def run_states(spark, sf_dir, v):
    done = v("verif").where("passed").select(F.col("claim").alias("k"))
    return closure.run_status(v("obligation").where("status <> 'P'"), v("obligation").join(done, "k", "left_semi"), "stream", "k")


@query("""+c AS (SELECT claim, count(*) FILTER (relation = 'supports') AS supports, count(*) FILTER (relation = 'reproduces') AS reproduces, count(*) FILTER (relation = 'contradicts') AS contradicts FROM bound GROUP BY claim)
    SELECT * FROM (SELECT claim, 'supports' AS kind, supports AS n FROM c WHERE supports NOT BETWEEN 1 AND 3 UNION ALL SELECT claim, 'reproduces', reproduces FROM c WHERE reproduces > 2 UNION ALL SELECT claim, 'contradicts', contradicts FROM c WHERE contradicts > 1)""", "bound")
def bundle_faults(spark, sf_dir, v):
    return closure.bundle_faults(v("bound").withColumnRenamed("relation", "kind"), "claim", {"supports": (1, 3), "reproduces": (0, 2), "contradicts": (0, 1)})


@query("""+t AS (SELECT claim, count(*) + CASE WHEN claim % 97 = 0 THEN 1 ELSE 0 END AS n FROM bound WHERE claim % 89 <> 0 GROUP BY claim), c AS (SELECT claim, count(*) AS n FROM bound GROUP BY claim)
    SELECT *, 'told' AS side FROM (SELECT * FROM t EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'computed' FROM (SELECT * FROM c EXCEPT SELECT * FROM t)""", "bound")
def recomputed_reports(spark, sf_dir, v):
    real = v("bound").groupBy("claim").agg(F.count(F.lit(1)).alias("n"))
    told = real.where("claim % 89 <> 0").withColumn("n", F.col("n") + F.when(F.col("claim") % 97 == 0, 1).otherwise(0))
    return closure.differing(told, real)


_MATCH = """+u AS (SELECT path, qualified, min(k) AS source FROM callable_before GROUP BY 1, 2 HAVING count(*) = 1), w AS (SELECT path, qualified, min(k) AS target FROM callable_after GROUP BY 1, 2 HAVING count(*) = 1),
    one AS (SELECT source, target FROM u JOIN w USING (path, qualified)), l AS (SELECT *, row_number() OVER (PARTITION BY path, name, params ORDER BY s, k) AS r FROM callable_before WHERE k NOT IN (SELECT source FROM one)),
    r AS (SELECT *, row_number() OVER (PARTITION BY path, name, params ORDER BY s, k) AS r FROM callable_after WHERE k NOT IN (SELECT target FROM one)),
    m AS (SELECT * FROM one UNION ALL SELECT l.k, r.k FROM l FULL JOIN r ON l.path = r.path AND l.name = r.name AND l.params = r.params AND l.r = r.r),
    hit AS (SELECT DISTINCT c.k FROM callable_after c LEFT JOIN hunk h ON h.path = c.path AND h.s <= c.e AND c.s <= h.e LEFT JOIN deletion d ON d.path = c.path AND c.s <= d.n AND d.n < c.e WHERE h.path IS NOT NULL OR d.path IS NOT NULL),
    ch AS (SELECT source, target, CASE WHEN source IS NULL THEN 'added' WHEN target IS NULL THEN 'removed' WHEN target IN (SELECT k FROM hit) OR b.public <> a.public THEN 'modified' ELSE 'unchanged' END AS status,
    coalesce(b.signature <> a.signature, false) AS signature_changed, coalesce(b.public <> a.public, false) AS visibility_changed, coalesce(b.public, false) AS was_public, coalesce(a.public, false) AS is_public
    FROM m LEFT JOIN callable_before b ON b.k = source LEFT JOIN callable_after a ON a.k = target)"""
_CALLABLE_VIEWS = ("callable_before", "callable_after", "hunk", "deletion")


def _changed(v) -> DataFrame:
    return callables.changes(v("callable_before"), v("callable_after"), v("hunk"), v("deletion"))


@query(_MATCH + " SELECT source, target FROM m", *_CALLABLE_VIEWS)
def callable_matches(spark, sf_dir, v):
    return callables.match(v("callable_before"), v("callable_after"))


@query(_MATCH + " SELECT * FROM ch", *_CALLABLE_VIEWS)
def callable_changes(spark, sf_dir, v):
    return _changed(v)


@query("+hit AS (SELECT c.k FROM callable_after c WHERE EXISTS (SELECT 1 FROM hunk h WHERE h.path = c.path AND h.s <= c.e AND c.s <= h.e) OR EXISTS (SELECT 1 FROM deletion d WHERE d.path = c.path AND c.s <= d.n AND d.n < c.e)) SELECT * FROM hit", "callable_after", "hunk", "deletion")
def touched_callables(spark, sf_dir, v):
    return callables.touched(v("callable_after"), v("hunk"), v("deletion"))


@query(_MATCH + """, live AS (SELECT target FROM ch WHERE status IN ('added', 'modified') AND (was_public OR is_public))
    SELECT 'changed' AS kind, target::VARCHAR AS key, target AS subject FROM live UNION ALL SELECT 'caller', (caller + 5000000) || ':' || (callee + 5000000), caller + 5000000 FROM calls WHERE caller <> callee AND callee + 5000000 IN (SELECT target FROM live)
    UNION ALL SELECT 'removed', source::VARCHAR, source FROM ch WHERE status = 'removed' AND was_public UNION ALL SELECT DISTINCT 'gap', path, NULL::BIGINT FROM artifact WHERE path NOT LIKE '%.rs'""", *_CALLABLE_VIEWS, "calls", "artifact")
def change_run(spark, sf_dir, v):
    edges = v("calls").select((F.col("caller") + 5000000).alias("caller"), (F.col("callee") + 5000000).alias("callee"))
    return callables.run_obligations(_changed(v), edges, v("artifact").where("path NOT LIKE '%.rs'"))


@query("""SELECT callee, count(*) FILTER (resolution = 'syntactic_unique') AS exact, count(*) FILTER (resolution = 'unresolved') AS name_only, count(*) FILTER (resolution = 'ambiguous') AS ambiguous FROM calls GROUP BY callee""", "calls")
def callers_by_confidence(spark, sf_dir, v):
    kind = F.when(F.col("resolution") == "syntactic_unique", "exact").when(F.col("resolution") == "unresolved", "name_only").otherwise(F.col("resolution"))
    return callables.callers_by_confidence(v("calls").withColumn("confidence", kind))


@query("""WITH i AS (SELECT s_suppkey AS id, 'm' || s_suppkey % 70 AS module FROM supplier), f AS (SELECT DISTINCT 'm' || n_nationkey || CASE n_regionkey WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.d.ts' END AS file FROM nation
    UNION SELECT 'm' || n_nationkey || '/index.ts' FROM nation WHERE n_nationkey % 2 = 0), s(place, suffix) AS (VALUES (0, '.ts'), (1, '.tsx'), (2, '.d.ts'), (3, '/index.ts'))
    SELECT id, arg_min(file, place) AS file, min(CASE WHEN file IS NOT NULL THEN place END)::INT AS place FROM (SELECT id, place, f.file FROM i CROSS JOIN s LEFT JOIN f ON f.file = module || suffix) GROUP BY id""")
def module_files(spark, sf_dir, v):
    imports = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("concat('m', s_suppkey % 70)").alias("module"))
    nation = table(spark, sf_dir, "nation")
    files = nation.select(F.expr("concat('m', n_nationkey, CASE n_regionkey WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.d.ts' END)").alias("file"))
    return callables.specifiers(imports, files.union(nation.where("n_nationkey % 2 = 0").select(F.expr("concat('m', n_nationkey, '/index.ts')"))), [".ts", ".tsx", ".d.ts", "/index.ts"])


@query("""+n AS (SELECT name, scope, count(*) AS n, min(k) AS k FROM declaration GROUP BY 1, 2)
    SELECT call_id, c.scope, c.name, CASE WHEN n = 1 THEN k END AS k, CASE WHEN n IS NULL THEN 'unresolved_name' WHEN n > 1 THEN 'ambiguous_name' ELSE 'fact' END AS outcome FROM call_site c LEFT JOIN n ON n.name = c.name AND n.scope = c.scope""", "call_site", "declaration")
def local_calls(spark, sf_dir, v):
    return callables.by_count(v("call_site"), v("declaration"), ["name", "scope"], "k", "unresolved_name", "ambiguous_name")


@query("""+a AS (SELECT path, name, params, count(*) AS n, min(s) AS s, min(e) AS e FROM callable_after GROUP BY 1, 2, 3)
    SELECT b.k AS id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN a.s <> b.s OR a.e <> b.e THEN 'location_mismatch' ELSE 'fact' END AS outcome FROM callable_before b LEFT JOIN a ON a.path = b.path AND a.name = b.name AND a.params = b.params""", "callable_before", "callable_after")
def raw_occurrences(spark, sf_dir, v):
    return callables.occurrences(v("callable_before").withColumnRenamed("k", "id"), v("callable_after"), ["path", "name", "params"])


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 1 THEN 'relative_target_unread' WHEN p_size % 3 = 2 THEN 'relative_target_ambiguous' WHEN p_partkey % 5 = 0 THEN 'relative_target_excluded' WHEN p_size % 3 = 0 THEN 'relative_target_missing' END AS reason FROM part""")
def relative_imports(spark, sf_dir, v):
    reason = callables.relative_reason(F.col("p_size") % 4 != 1, F.col("p_partkey") % 5 == 0, F.col("p_size") % 3)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reason.alias("reason"))
