"""Every registered query of the engine with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalar
from .model import PPM, digest
from .operators import diff, discover, evidence, glue, reporting, resolve, review, rules
from .plans import waves
from .registry import ORACLE_SQL, QUERIES, query, table
from .sources import listings
from .streaming import lifecycle

__all__ = ["ORACLE_SQL", "QUERIES"]

_CLASS = """CASE WHEN list_has_any(string_split({0}, '/'), ['third_party', 'vendor', 'vendored']) THEN 'vendor' WHEN list_has_any(string_split({0}, '/'), ['generated', 'target']) OR {0} LIKE '%.generated.rs' THEN 'generated'
    WHEN list_has_any(string_split({0}, '/'), ['benches', 'tests', 'benchmarks']) OR regexp_matches({0}, '(^|/)tests?[.]rs$|_tests?[.]rs$') THEN 'test' WHEN list_has_any(string_split({0}, '/'), ['example', 'examples']) THEN 'example'
    WHEN list_has_any(string_split({0}, '/'), ['doc', 'docs']) THEN 'docs' WHEN {0} LIKE '%.rs' THEN 'production' ELSE 'other' END"""


_CHANGED = """+chg AS (SELECT member AS k, count(*) AS witnesses FROM contains WHERE container IN (SELECT k FROM change) GROUP BY member),
    pub AS (SELECT a.*, coalesce(witnesses, 0) AS witnesses FROM artifact a LEFT JOIN chg USING (k) WHERE public AND (own_change OR witnesses IS NOT NULL))"""


@query(_CHANGED + " SELECT id, path, witnesses FROM pub", "artifact", "contains", "change")
def changed_public_symbols(spark, sf_dir, v):
    return rules.changed_public(v("artifact"), v("contains"), v("change")).select("id", "path", "witnesses")


@query(_CHANGED + f""", x AS (SELECT c.caller, c.callee, c.resolution, p.witnesses, {_CLASS.format('p.path')} AS cc, {_CLASS.format('a.path')} AS rc
    FROM calls c JOIN pub p ON p.k = c.callee JOIN artifact a ON a.k = c.caller WHERE c.caller <> c.callee)
    SELECT caller, callee, witnesses, CASE WHEN cc <> 'production' THEN 'callee_' || cc WHEN rc <> 'production' THEN 'caller_' || rc WHEN resolution <> 'syntactic_unique' THEN 'obstruction_' || resolution ELSE 'obligation' END AS outcome,
    'obligation:sha256:' || sha256('relation.changed_public_callee@1|' || caller || '|' || callee) AS id FROM x""", "artifact", "contains", "change", "calls")
def changed_callee_obligations(spark, sf_dir, v):
    return rules.changed_callee(v("artifact"), v("contains"), v("change"), v("calls"))


@query("SELECT src, dst FROM external_call WHERE idempotency IS NULL AND dst IN (SELECT k FROM side_effect)", "external_call", "side_effect")
def contract_calls(spark, sf_dir, v):
    return rules.contract_calls(v("external_call"), v("side_effect"))


@query("""SELECT h.src AS event, h.dst AS handler, c.member AS callee, t.dst AS effect FROM handled_by h JOIN contains c ON c.container = h.dst
    JOIN external_call t ON t.src = c.member WHERE t.idempotency IS NULL AND t.dst IN (SELECT k FROM side_effect)""", "handled_by", "contains", "external_call", "side_effect")
def effect_paths(spark, sf_dir, v):
    return rules.effect_paths(v("handled_by"), v("contains"), rules.contract_calls(v("external_call"), v("side_effect")))


@query("""WITH inv AS (SELECT DISTINCT r_regionkey AS invariant, n_nationkey AS scope FROM region JOIN nation ON n_regionkey = r_regionkey),
    mem AS (SELECT DISTINCT c_mktsegment || '-' || c_custkey % 20 AS path, c_nationkey AS scope FROM customer)
    SELECT i.invariant, m.path FROM inv i JOIN mem m USING (scope) JOIN (SELECT invariant, count(*) AS n FROM inv GROUP BY invariant) z ON z.invariant = i.invariant GROUP BY i.invariant, m.path, z.n HAVING count(*) = z.n""")
def invariant_scopes(spark, sf_dir, v):
    inv = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("invariant"), F.col("n_nationkey").alias("scope")).distinct()
    mem = table(spark, sf_dir, "customer").select(F.expr("concat(c_mktsegment, '-', c_custkey % 20)").alias("path"), F.col("c_nationkey").alias("scope")).distinct()
    return rules.scope_covered(inv, mem)


@query("""+r(rule, need) AS (SELECT n_name, unnest(['ast', CASE WHEN n_nationkey % 2 = 0 THEN 'direct_calls' ELSE 'concurrency_model' END, CASE WHEN n_nationkey % 3 = 0 THEN 'tests' ELSE 'containment' END]) FROM nation)
    SELECT rule, need AS capability, 'capability_' || coalesce(state, 'undeclared') AS reason FROM r LEFT JOIN capability ON capability = need WHERE coalesce(state, 'undeclared') <> 'complete'""", "capability")
def capability_gaps(spark, sf_dir, v):
    need = F.array(F.lit("ast"), F.expr("if(n_nationkey % 2 = 0, 'direct_calls', 'concurrency_model')"), F.expr("if(n_nationkey % 3 = 0, 'tests', 'containment')"))
    return rules.capability_gaps(table(spark, sf_dir, "nation").select(F.col("n_name").alias("rule"), need.alias("required")), v("capability"))


@query(f"SELECT path, {_CLASS.format('path')} AS class, count(*) AS n FROM artifact GROUP BY ALL", "artifact")
def path_classes(spark, sf_dir, v):
    return v("artifact").groupBy("path", scalar.path_class(F.col("path")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN weight <= 0.25 THEN 'info' WHEN weight <= 0.5 THEN 'low' WHEN weight <= 1 THEN 'medium' WHEN weight <= 2 THEN 'high' ELSE 'critical' END AS risk, count(*) AS n
    FROM obligation GROUP BY 1""", "obligation")
def risk_buckets(spark, sf_dir, v):
    return v("obligation").groupBy(scalar.risk(F.col("weight")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


_AXES = """+f AS (SELECT k, bool_or(relation <> 'R') AS supported, bool_and(outcome = 'F') AS verified, CASE WHEN bool_or(snapshot <> (SELECT max(snapshot) FROM binding)) THEN 'stale' ELSE 'fresh' END AS freshness FROM binding GROUP BY k),
    ax AS (SELECT o.k, o.weight::DECIMAL(18, 6) AS w, status = 'F' AS completed, coalesce(supported, false) AS supported, coalesce(verified, false) AS verified, coalesce(freshness, 'unknown') AS freshness FROM obligation o LEFT JOIN f USING (k))"""


def _axes(v) -> DataFrame:
    current = v("binding").agg(F.max("snapshot")).first()[0]
    return evidence.axes(v("obligation"), evidence.flags(v("binding"), F.lit(current)))


@query(_AXES + """, l AS (SELECT w, unnest(['completed', 'supported', 'verified', 'fresh']) AS axis, unnest([completed, supported, verified, verified AND freshness = 'fresh']) AS q FROM ax)
    SELECT axis, count(*) FILTER (q) AS qualified, count(*) AS denominator, round(count(*) FILTER (q) / count(*)::DOUBLE, 6) AS ratio, round(sum(CASE WHEN q THEN w ELSE 0 END)::DOUBLE / sum(w)::DOUBLE, 6) AS weighted FROM l GROUP BY axis""", "obligation", "binding")
def coverage_axes(spark, sf_dir, v):
    return evidence.coverage(_axes(v))


@query(_AXES + " SELECT x.freshness, (SELECT count(*) FROM ax WHERE ax.freshness = x.freshness) AS n FROM (VALUES ('fresh'), ('stale'), ('unknown')) x(freshness)", "obligation", "binding")
def freshness_histogram(spark, sf_dir, v):
    return evidence.histogram(_axes(v), "freshness", ["fresh", "stale", "unknown"])


@query("SELECT k, evidence FROM binding WHERE k NOT IN (SELECT k FROM change)", "binding", "change")
def unbound_references(spark, sf_dir, v):
    return evidence.violations(v("binding").select("k", "evidence"), v("change"), "k")


@query("SELECT k FROM obligation WHERE k IN (SELECT k FROM binding) AND k NOT IN (SELECT k FROM binding WHERE outcome <> 'F')", "obligation", "binding")
def fully_verified(spark, sf_dir, v):
    f = v("binding").groupBy("k").agg(F.min(F.col("outcome") == "F").alias("every"))
    return v("obligation").select("k").join(f.where("every"), "k", "left_semi")


@query("""+g AS (SELECT body_hash, count(*) AS members, min(end_line - start_line + 1)::BIGINT AS span, min(k) AS least FROM artifact GROUP BY body_hash HAVING count(*) > 1)
    SELECT *, row_number() OVER (ORDER BY span DESC, members DESC, least) AS rank FROM g""", "artifact")
def exact_groups(spark, sf_dir, v):
    return discover.exact_groups(v("artifact"))


@query("SELECT shape_hash, count(*) AS members, count(DISTINCT body_hash) AS bodies FROM artifact GROUP BY shape_hash HAVING count(*) > 1 AND count(DISTINCT body_hash) > 1", "artifact")
def near_groups(spark, sf_dir, v):
    return discover.near_groups(v("artifact"))


_TERMS = "WITH t AS (SELECT DISTINCT doc_id AS id, unnest(string_split(lower(text), ' ')) AS term FROM documents), p AS (SELECT * FROM t WHERE term <> ''), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"


def _posted(spark, sf_dir) -> DataFrame:
    return discover.terms(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_TERMS + " SELECT df, count(*) AS terms FROM df GROUP BY df")
def term_frequencies(spark, sf_dir, v):
    return discover.document_frequency(_posted(spark, sf_dir)).groupBy("df").agg(F.count(F.lit(1)).alias("terms"))


_QUERY = ["atan", "ines", "aner", "orer", "thion", "inth", "the", "zzz"]
_ASKED = "(VALUES ('atan'), ('ines'), ('aner'), ('orer'), ('thion'), ('inth'), ('the'), ('zzz')) q(term)"
_CAP = "(SELECT greatest(32, ceil(count(*) / 5.0)) FROM documents)"


@query(_TERMS + f"""+ , m AS (SELECT p.id, count(*) AS matched FROM p JOIN df USING (term) JOIN {_ASKED} USING (term) WHERE df <= {_CAP} GROUP BY p.id)
    SELECT id, matched, (matched * 1000000 // 8)::BIGINT AS ppm, row_number() OVER (ORDER BY id) AS rank FROM m WHERE matched >= 2 AND matched * 1000000 // 8 >= 250000""".replace("+ ,", ","))
def responsibility_search(spark, sf_dir, v):
    return discover.search(_posted(spark, sf_dir), _QUERY, discover.cap(table(spark, sf_dir, "documents").count()), least_ppm=250_000)


@query(_TERMS + f" SELECT q.term, CASE WHEN df IS NULL THEN 'absent' WHEN df > {_CAP} THEN 'high_frequency' ELSE 'selective' END AS status FROM {_ASKED} LEFT JOIN df USING (term)")
def query_terms(spark, sf_dir, v):
    return discover.query_terms(_posted(spark, sf_dir), _QUERY, discover.cap(table(spark, sf_dir, "documents").count()))


@query("SELECT l_returnflag AS kind, l_linestatus AS provenance, count(*) AS n FROM lineitem GROUP BY ALL")
def relation_inventory(spark, sf_dir, v):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT finding, root FROM finding f JOIN root_span r ON f.path = r.path AND f.tag = r.tag AND f.s <= r.e AND r.s <= f.e", "finding", "root_span")
def finding_matches(spark, sf_dir, v):
    return resolve.overlapping(v("finding"), v("root_span"))


@query("""+h AS (SELECT DISTINCT finding, root FROM finding f JOIN root_span r ON f.path = r.path AND f.tag = r.tag AND f.s <= r.e AND r.s <= f.e)
    SELECT count(DISTINCT root) AS detected, count(DISTINCT finding) AS matched, (SELECT count(DISTINCT finding) FROM finding) - count(DISTINCT finding) AS unmatched FROM h""", "finding", "root_span")
def finding_score(spark, sf_dir, v):
    return resolve.score(v("finding"), v("root_span"))


_RESOLVED = """+r AS (SELECT call_id, c.scope, c.name, count(*) FILTER (d.scope = c.scope) AS near, count(d.scope) AS far FROM call_site c LEFT JOIN declaration d ON d.name = c.name GROUP BY ALL),
    z AS (SELECT call_id, scope, name, CASE WHEN near > 0 THEN 'scope' WHEN far > 0 THEN 'name' ELSE 'none' END AS tier, CASE WHEN near > 0 THEN near ELSE far END AS candidates, near FROM r),
    y AS (SELECT call_id, scope, name, tier, candidates, CASE WHEN candidates = 0 THEN 'unresolved' WHEN candidates > 1 THEN 'ambiguous' WHEN near = 1 THEN 'exact' ELSE 'name_only' END AS confidence FROM z)"""


@query(_RESOLVED + " SELECT * FROM y", "call_site", "declaration")
def call_resolution(spark, sf_dir, v):
    return resolve.resolve_calls(v("call_site"), v("declaration"))


@query(_RESOLVED + """ SELECT x.confidence, count(y.call_id) AS n FROM (VALUES ('exact'), ('name_only'), ('ambiguous'), ('over_fanout'), ('unresolved')) x(confidence)
    LEFT JOIN y ON CASE WHEN y.confidence = 'ambiguous' AND candidates > 5 THEN 'over_fanout' ELSE y.confidence END = x.confidence GROUP BY 1""", "call_site", "declaration")
def call_statistics(spark, sf_dir, v):
    return resolve.call_stats(resolve.resolve_calls(v("call_site"), v("declaration")))


@query("""+p AS (SELECT path, greatest(1, s * 20 - 48)::BIGINT AS s, least(700, s * 20 + 50, greatest(1, s * 20 - 48) + 159)::BIGINT AS e, finding AS id FROM finding),
    w AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s, e, id) AS i FROM w),
    m AS (SELECT path, min(s) AS s, max(e) AS e, count(*) AS seeds FROM i GROUP BY path, i), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s) AS r, greatest(0, count(*) OVER (PARTITION BY path) - 8) AS omitted FROM m)
    SELECT path, s, e, seeds, omitted FROM n WHERE r <= 8""", "finding")
def target_windows(spark, sf_dir, v):
    seeds = v("finding").select("path", (F.col("s") * 20).alias("s"), (F.col("s") * 20 + 2).alias("e"), F.col("finding").alias("id"))
    return resolve.windows(seeds, 700)


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.body <> b.body AND a.anchor <> b.anchor THEN 'anchor_changed+body_changed'
    WHEN a.anchor <> b.anchor THEN 'anchor_changed' WHEN a.body <> b.body THEN 'body_changed' ELSE 'preserved' END AS reason FROM before_fn a FULL JOIN after_fn b ON a.k = b.k""", "before_fn", "after_fn")
def member_diff(spark, sf_dir, v):
    return diff.member_diff(v("before_fn"), v("after_fn"), "k", ["anchor", "body"])


@query("""+one AS (SELECT a.k AS source, b.k AS target FROM before_fn a JOIN after_fn b ON a.k = b.k), l AS (SELECT k AS source, anchor FROM before_fn WHERE k NOT IN (SELECT source FROM one)),
    r AS (SELECT k AS target, anchor FROM after_fn WHERE k NOT IN (SELECT target FROM one)),
    two AS (SELECT source, target FROM (SELECT anchor, min(source) AS source FROM l GROUP BY anchor HAVING count(*) = 1) JOIN (SELECT anchor, min(target) AS target FROM r GROUP BY anchor HAVING count(*) = 1) USING (anchor))
    SELECT source, target, 'key' AS stage FROM one UNION ALL SELECT source, target, 'label' FROM two UNION ALL SELECT source, NULL, 'removed' FROM l WHERE source NOT IN (SELECT source FROM two)
    UNION ALL SELECT NULL, target, 'added' FROM r WHERE target NOT IN (SELECT target FROM two)""", "before_fn", "after_fn")
def snapshot_mapping(spark, sf_dir, v):
    return diff.staged_mapping(v("before_fn"), v("after_fn"), "k", "anchor")


@query("""+s AS (SELECT anchor || body AS key, count(*) AS n, min(body) AS b FROM before_fn GROUP BY 1), t AS (SELECT anchor || body AS key, count(*) AS n, min(body) AS b FROM after_fn GROUP BY 1)
    SELECT key, CASE WHEN s.n IS NULL THEN 'added' WHEN t.n IS NULL THEN 'removed' WHEN s.n = 1 AND t.n = 1 THEN CASE WHEN s.b = t.b THEN 'preserved' ELSE 'modified' END
    WHEN s.n = 1 THEN 'split' WHEN t.n = 1 THEN 'merged' ELSE 'unresolved' END AS status FROM s FULL JOIN t USING (key)""", "before_fn", "after_fn")
def component_status(spark, sf_dir, v):
    keyed = lambda d: d.withColumn("key", F.concat("anchor", "body"))
    return diff.component_status(keyed(v("before_fn")), keyed(v("after_fn")), "key", "body")


@query("""+d AS (SELECT k, body FROM after_fn UNION ALL SELECT k, body FROM after_fn WHERE k % 19 = 0), g AS (SELECT k, count(*) AS n, min(body) AS body FROM d GROUP BY k),
    x AS (SELECT coalesce(e.k, g.k) AS k, CASE WHEN g.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN e.body <> g.body THEN 'mismatched' END AS problem FROM before_fn e FULL JOIN g ON e.k = g.k)
    SELECT * FROM x WHERE problem IS NOT NULL""", "before_fn", "after_fn")
def source_admission(spark, sf_dir, v):
    after = v("after_fn")
    return diff.admission(v("before_fn"), after.unionByName(after.where("k % 19 = 0")), "k", "body")


@query("SELECT l_orderkey AS k, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) <> 1 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def partition_faults(spark, sf_dir, v):
    return diff.partition_faults(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), "k")


@query("SELECT id, CASE WHEN r = 1 THEN label ELSE label || '~' || r END AS stable_key FROM (SELECT id, label, row_number() OVER (PARTITION BY path, label ORDER BY k) AS r FROM artifact)", "artifact")
def stable_keys(spark, sf_dir, v):
    return diff.ordinals(v("artifact"), "path", "label", ["k"]).select("id", "stable_key")


@query("SELECT id, row_number() OVER (PARTITION BY stream ORDER BY made_at, k) - 1 AS level FROM obligation", "obligation")
def chain_levels(spark, sf_dir, v):
    return waves.chain_levels(v("obligation"), "stream", ["made_at", "k"])


_STEPS = ("('generated','planned'),('planned','in_progress'),('in_progress','completed'),('generated','stale'),('generated','superseded'),('generated','cancelled'),('planned','stale'),('planned','superseded'),"
          "('planned','cancelled'),('in_progress','stale'),('in_progress','superseded'),('in_progress','cancelled'),('completed','stale'),('completed','superseded')")


@query(f"""+w AS (SELECT seq, stream, lag(state) OVER (PARTITION BY stream ORDER BY seq) AS before, state FROM event)
    SELECT seq, stream, before, state FROM w WHERE before IS NOT NULL AND (before, state) NOT IN (VALUES {_STEPS})""", "event")
def illegal_transitions(spark, sf_dir, v):
    return lifecycle.transition_violations(v("event"))


@query("SELECT stream, arg_max(state, seq) AS state, max(seq) AS seq, count(*) AS n FROM event GROUP BY stream", "event")
def latest_states(spark, sf_dir, v):
    return lifecycle.latest(v("event"))


@query("""+s AS (SELECT k AS pair, CASE relation WHEN 'A' THEN 'unknown' WHEN 'N' THEN 'satisfied' ELSE 'required' END AS assignment, outcome = 'F' AS verified, evidence % 3 = 0 AS qualified FROM binding),
    g AS (SELECT pair, count(*) AS n, count(DISTINCT assignment) AS vals, bool_or(assignment = 'unknown') AS open, bool_and(verified) AS verified, bool_or(qualified) AS qualified FROM s GROUP BY pair),
    o AS (SELECT g.*, CASE WHEN n <> 2 THEN 'required_section_missing' WHEN pair % 4 = 0 THEN 'required_overlap_missing' WHEN open THEN 'section_unknown' WHEN vals > 1 THEN 'assignment_conflict' END AS obstruction FROM g)
    SELECT pair, CASE WHEN obstruction = 'assignment_conflict' THEN 'failed' WHEN obstruction IS NOT NULL THEN 'unknown' WHEN NOT verified THEN 'candidate' WHEN qualified THEN 'glued_with_qualification' ELSE 'glued' END AS result, obstruction FROM o""", "binding")
def gluing(spark, sf_dir, v):
    b = v("binding")
    assignment = F.when(F.col("relation") == "A", "unknown").when(F.col("relation") == "N", "satisfied").otherwise("required")
    sections = b.select(F.col("k").alias("pair"), assignment.alias("assignment"), (F.col("outcome") == "F").alias("verified"), (F.col("evidence") % 3 == 0).alias("qualified"))
    return glue.glue(sections, b.where("k % 4 <> 0").select(F.col("k").alias("pair")))


@query("SELECT DISTINCT k, CASE WHEN k IN (SELECT container FROM contains) THEN 'covered' ELSE 'uncovered' END AS status FROM obligation", "obligation", "contains")
def cover_partition(spark, sf_dir, v):
    return glue.cover(v("obligation"), v("contains").withColumnRenamed("container", "k"), "k")


@query("""+a AS (SELECT k % 300 AS candidate, CASE evidence % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'safety' ELSE 'separation' END AS p, CASE WHEN outcome = 'F' THEN 'supports' WHEN relation = 'R' THEN 'opposes' ELSE 'unknown' END AS v FROM binding),
    g AS (SELECT candidate, coalesce(bool_and(v = 'supports') FILTER (p = 'contract'), false) AS c, coalesce(bool_and(v = 'supports') FILTER (p = 'safety'), false) AS s, coalesce(bool_or(v = 'supports') FILTER (p = 'separation'), false) AS x,
    coalesce(bool_or(v = 'opposes') FILTER (p = 'contract'), false) AS o FROM a GROUP BY candidate)
    SELECT candidate, CASE WHEN x AND o THEN 'intentional_separation' WHEN NOT x AND c AND s THEN 'shared_validator' WHEN NOT x AND c THEN 'shared_conformance_test' ELSE 'inconclusive' END AS decision FROM g""", "binding")
def family_decisions(spark, sf_dir, v):
    prop = F.when(F.col("evidence") % 3 == 0, "contract").when(F.col("evidence") % 3 == 1, "safety").otherwise("separation")
    verdict = F.when(F.col("outcome") == "F", "supports").when(F.col("relation") == "R", "opposes").otherwise("unknown")
    return glue.family_decision(v("binding").select((F.col("k") % 300).alias("candidate"), prop.alias("property"), verdict.alias("verdict")))


@query("SELECT stream, count(*) AS members, sha256(string_agg(id, ',' ORDER BY id)) AS set_digest FROM obligation GROUP BY stream", "obligation")
def set_digests(spark, sf_dir, v):
    return v("obligation").groupBy("stream").agg(F.count(F.lit(1)).alias("members"), digest(F.collect_list("id")).alias("set_digest"))


@query("SELECT n AS sorted_rank, v AS p95 FROM (SELECT c_nationkey AS v, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS n, count(*) OVER () AS total FROM customer) WHERE n = ceil(0.95 * total)")
def nearest_rank_p95(spark, sf_dir, v):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("c_nationkey").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.ceil(F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(95) / 100).cast("long")
    rows = c.select(F.col("c_nationkey").alias("p95"), F.sum("n").over(w).alias("upto"), "n", rank.alias("sorted_rank"))
    return rows.where("upto >= sorted_rank AND upto - n < sorted_rank").select("sorted_rank", "p95")


@query("SELECT l.toxic AS label, d.lang, count(*) AS n, (count(*) * 1000000 // (SELECT count(*) FROM labels))::BIGINT AS ppm FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def label_shares(spark, sf_dir, v):
    labels = table(spark, sf_dir, "labels")
    n = labels.count()
    rows = labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy(F.col("toxic").alias("label"), "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("ppm", F.floor(F.col("n") * F.lit(PPM) / F.lit(n)).cast("long"))


_REASONS = ["parse_failure", "unsupported_syntax", "unsupported_caller", "dynamic_dispatch", "relative_specifier_unsupported", "relative_target_unread", "relative_target_ambiguous", "relative_target_excluded", "relative_target_missing",
            "import_binding_ambiguous", "type_only_binding", "export_binding_unsupported", "import_resolution_unavailable", "shadowed_binding", "written_binding", "unresolved_name", "other"]


@query("WITH r AS (SELECT user_id AS stream, (event_id * 7 + user_id) % 17 AS p FROM events) SELECT stream, [" + ", ".join(f"'{r}'" for r in _REASONS) + "][min(p) + 1] AS reason FROM r GROUP BY stream")
def strongest_reasons(spark, sf_dir, v):
    why = F.element_at(F.array(*[F.lit(r) for r in _REASONS]), ((F.col("event_id") * 7 + F.col("user_id")) % 17 + 1).cast("int"))
    return review.strongest_reason(table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), why.alias("why")), "stream", "why")


@query(_RESOLVED + """, e AS (SELECT y.scope, d.k AS callee, call_id, CASE confidence WHEN 'exact' THEN 0 WHEN 'name_only' THEN 1 ELSE 2 END AS r FROM y JOIN declaration d ON d.name = y.name
    WHERE confidence <> 'unresolved' AND NOT (confidence = 'ambiguous' AND candidates > 5) AND (tier = 'name' OR d.scope = y.scope))
    SELECT scope, callee, CASE min(r) WHEN 0 THEN 'exact' WHEN 1 THEN 'name_only' ELSE 'ambiguous' END AS confidence, count(DISTINCT call_id) AS sites FROM e GROUP BY scope, callee""", "call_site", "declaration")
def call_edges(spark, sf_dir, v):
    return review.call_edges(resolve.resolve_calls(v("call_site"), v("declaration")), v("call_site"), v("declaration"))


@query("SELECT k, call_id FROM declaration LEFT JOIN call_site USING (name)", "call_site", "declaration")
def removed_callers(spark, sf_dir, v):
    return review.removed_callers(v("declaration"), v("call_site"))


@query("SELECT DISTINCT s.k, c.src, c.dst FROM side_effect s JOIN touches_supplier c ON c.src = s.k OR c.dst = s.k", "side_effect", "touches_supplier")
def neighbourhoods(spark, sf_dir, v):
    return review.neighbourhood(v("side_effect"), v("touches_supplier"))


@query("SELECT x.k AS a, y.k AS b FROM artifact x JOIN artifact y ON x.path = y.path AND x.k < y.k AND x.start_line <= y.end_line AND y.start_line <= x.end_line", "artifact")
def overlapping_spans(spark, sf_dir, v):
    return review.overlapping_spans(v("artifact").select("path", F.col("k").alias("id"), F.col("start_line").alias("s"), F.col("end_line").alias("e")))


@query("""WITH RECURSIVE w AS (SELECT s_suppkey AS id, s_suppkey AS last, 0 AS hops FROM supplier UNION ALL SELECT id, last // 3, hops + 1 FROM w WHERE last > 2 AND hops < 8)
    SELECT id, min_by(last, -hops) AS last, max(hops) AS hops FROM w GROUP BY id""")
def reexport_chains(spark, sf_dir, v):
    s = table(spark, sf_dir, "supplier")
    links = s.where("s_suppkey > 2").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 3").alias("dst"))
    return review.follow_chain(s.select(F.col("s_suppkey").alias("id")), links)


@query("""SELECT CASE WHEN o_orderkey NOT IN (SELECT k FROM binding) THEN 'missing' WHEN o_orderkey NOT IN (SELECT k FROM binding WHERE relation = 'N') THEN 'unscored' ELSE 'scored' END AS status, count(*) AS n
    FROM orders GROUP BY 1""", "binding")
def run_summary(spark, sf_dir, v):
    return review.run_summary(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), v("binding"), v("binding").where("relation = 'N'"), "k")


@query("""+p AS (SELECT scope, name, substr(sha256(call_id::VARCHAR), 1, 2) AS p, count(*) AS n, sha256(string_agg(call_id::VARCHAR, ',' ORDER BY call_id::VARCHAR)) AS d FROM call_site GROUP BY ALL)
    SELECT scope, name, sum(n)::BIGINT AS n, sha256(string_agg(d, ',' ORDER BY p)) AS ids FROM p GROUP BY scope, name""", "call_site")
def unresolved_buckets(spark, sf_dir, v):
    return reporting.unresolved(v("call_site"), ["scope", "name"], "call_id")


@query("""SELECT k, CASE WHEN count(*) FILTER (relation <> 'A') = 0 THEN 'incomplete' WHEN count(*) FILTER (relation <> 'A') = count(*) FILTER (relation <> 'A' AND outcome = 'F') THEN 'pass' ELSE 'blocked' END AS gate
    FROM binding GROUP BY k""", "binding")
def gates(spark, sf_dir, v):
    return review.gate(v("binding"), F.col("relation") != "A", F.col("outcome") == "F")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS excerpt FROM documents")
def line_excerpts(spark, sf_dir, v):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", review.excerpt(docs, "text", 2, 2).alias("excerpt"))


@query("""SELECT s_nationkey AS family, NULL::BIGINT AS member, unnest(['change_reason', 'separation', 'conformance']) AS property FROM (SELECT DISTINCT s_nationkey FROM supplier)
    UNION ALL SELECT s_nationkey, s_suppkey, unnest(['contract', 'purpose', 'input', 'output', 'effects', 'errors']) FROM supplier""")
def decision_obligations(spark, sf_dir, v):
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("member"))
    return review.members_times_properties(members, "family", ["change_reason", "separation", "conformance"], ["contract", "purpose", "input", "output", "effects", "errors"])


@query("""+d AS (SELECT stream, max(seq) AS seq, arg_max(state, seq) AS value FROM event WHERE state IN ('completed', 'planned') GROUP BY stream), i AS (SELECT stream, max(seq) AS struck FROM event WHERE state = 'stale' GROUP BY stream)
    SELECT stream, seq, value FROM d LEFT JOIN i USING (stream) WHERE struck IS NULL OR struck < seq""", "event")
def active_decisions(spark, sf_dir, v):
    e = v("event")
    return review.last_valid(e.where("state IN ('completed', 'planned')").withColumnRenamed("state", "value"), e.where("state = 'stale'"), "stream")


@query("SELECT seq AS id, stream, lag(seq) OVER (PARTITION BY stream ORDER BY seq) AS supersedes FROM event WHERE state = 'completed'", "event")
def superseded_findings(spark, sf_dir, v):
    return review.superseded(v("event").where("state = 'completed'").withColumn("id", F.col("seq")), "stream").select("id", "stream", "supersedes")


@query("SELECT k, '{\"id\":\"' || id || '\",\"status\":\"' || status || '\",\"stream\":' || stream || '}' AS report FROM obligation", "obligation")
def obligation_reports(spark, sf_dir, v):
    return review.json_report(v("obligation"), "k", ["status", "id", "stream"])


@query("SELECT p_partkey AS k, list_aggregate(list_sort(list_distinct(string_split(lower(p_name), ' '))), 'string_agg', ',') AS words FROM part")
def identifier_words(spark, sf_dir, v):
    return v("artifact").select("k", F.array_join(scalar.identifier_words(F.col("label")), ",").alias("words"))


@query("""WITH RECURSIVE f AS (SELECT s_nationkey AS g, printf('%06d', s_suppkey) AS path, (s_suppkey * 37 % 90)::BIGINT AS size, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
    w AS (SELECT g, path, size, r, CASE WHEN size > 80 THEN 'file_too_large' WHEN size > 100 THEN 'total_exceeded' ELSE 'accepted' END AS outcome, CASE WHEN size <= 80 THEN size ELSE 0 END AS total FROM f WHERE r = 1
      UNION ALL SELECT f.g, f.path, f.size, f.r, CASE WHEN f.size > 80 THEN 'file_too_large' WHEN w.total + f.size > 100 THEN 'total_exceeded' ELSE 'accepted' END, w.total + CASE WHEN f.size <= 80 AND w.total + f.size <= 100 THEN f.size ELSE 0 END
      FROM w JOIN f ON f.g = w.g AND f.r = w.r + 1) SELECT g, path, size, outcome FROM w""")
def bounded_read(spark, sf_dir, v):
    files = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.format_string("%06d", "s_suppkey").alias("path"), (F.col("s_suppkey") * 37 % 90).alias("size"))
    return listings.admitted(files, "g", "path", "size", 80, 100)


@query("SELECT seq, stream FROM (SELECT seq, stream, lag(seq) OVER (PARTITION BY stream ORDER BY seq) AS p FROM event) WHERE p IS NOT NULL AND (seq <> p + 1 OR seq % 10 = 0) OR p IS NULL AND seq % 10 = 0", "event")
def chain_breaks(spark, sf_dir, v):
    e = v("event")
    before = F.lag("seq").over(Window.partitionBy("stream").orderBy("seq"))
    hashed = e.select("seq", "stream", F.sha2(F.col("seq").cast("string"), 256).alias("h"), F.when(F.col("seq") % 10 == 0, "broken").otherwise(F.sha2(before.cast("string"), 256)).alias("p"))
    return listings.chain_breaks(hashed, "seq", "h", "p", "stream").select("seq", "stream")


@query("SELECT CASE WHEN k IN (SELECT k FROM after_fn) THEN 'ok' ELSE 'patch_missing' END AS status, count(*) AS n FROM before_fn GROUP BY 1 UNION ALL SELECT 'unlisted', count(*) FROM after_fn WHERE k NOT IN (SELECT k FROM before_fn)", "before_fn", "after_fn")
def listing_cross_check(spark, sf_dir, v):
    paths = lambda d: d.select(F.col("k").alias("path"))
    return listings.cross_check(paths(v("before_fn")), paths(v("after_fn"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


from . import catalog_arms, catalog_calls, catalog_chain, catalog_checks, catalog_contexts, catalog_evidence, catalog_graph, catalog_reports, catalog_rules, catalog_runs, catalog_schemas, catalog_signals, catalog_snapshots  # noqa: E402, F401  register their queries
