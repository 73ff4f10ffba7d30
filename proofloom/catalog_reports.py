"""Queries of mappings, reports, discovery denominators, stores and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _ASKED, _CLASS, _QUERY, _TERMS, _posted
from .functions import scalar
from .operators import mapping, reporting
from .registry import query, table
from .sources import listings, stores

_STAGES = [("path", ["path", "qualified"]), ("rename", ["path", "qualified"]), ("label", ["qualified"]), ("anchor", ["path", "s", "name"]), ("key", ["name", "params", "signature"]),
           ("endpoints", ["name", "s", "e"]), ("members", ["name", "params"]), ("scope", ["path", "name"]), ("limitation", ["signature", "s"])]


def _mapping_sql() -> str:
    """The stages as a chain of common tables, each over what the one before left."""
    parts = ["rn AS (SELECT concat('f', n_nationkey) AS old, concat('f', n_nationkey + 3) AS new FROM nation)", "l0 AS (SELECT * FROM callable_before)", "r0 AS (SELECT * FROM callable_after)"]
    for i, (name, columns) in enumerate(_STAGES):
        c = ", ".join(columns)
        left = f"(SELECT l.* REPLACE (new AS path) FROM l{i} l JOIN rn ON old = path)" if name == "rename" else f"l{i}"
        parts.append(f"m{i} AS (SELECT source, target, '{name}' AS stage FROM (SELECT {c}, min(k) AS source FROM {left} GROUP BY {c} HAVING count(*) = 1) JOIN (SELECT {c}, min(k) AS target FROM r{i} GROUP BY {c} HAVING count(*) = 1) USING ({c}))")
        parts.append(f"l{i + 1} AS (SELECT * FROM l{i} WHERE k NOT IN (SELECT source FROM m{i}))")
        parts.append(f"r{i + 1} AS (SELECT * FROM r{i} WHERE k NOT IN (SELECT target FROM m{i}))")
    n = len(_STAGES)
    every = " UNION ALL ".join([f"SELECT * FROM m{i}" for i in range(n)] + [f"SELECT k, NULL, 'removed' FROM l{n}", f"SELECT NULL, k, 'added' FROM r{n}"])
    return "+" + ",\n".join(parts) + f", mapped AS ({every})"


def _mapped(spark, sf_dir, v) -> DataFrame:
    renames = table(spark, sf_dir, "nation").select(F.expr("concat('f', n_nationkey)").alias("old"), F.expr("concat('f', n_nationkey + 3)").alias("new"))
    return mapping.staged(v("callable_before"), v("callable_after"), _STAGES, renames)


@query(_mapping_sql() + " SELECT * FROM mapped", "callable_before", "callable_after")
def staged_snapshot_mapping(spark, sf_dir, v):
    return _mapped(spark, sf_dir, v)


@query("""+mapped AS (SELECT b.k AS source, a.k AS target FROM callable_before b JOIN callable_after a ON a.k = b.k + 5000000),
    x AS (SELECT 'r' || k % 3 AS rule, 'p' || k % 2 AS property, k AS target FROM callable_before UNION ALL SELECT 'r0', 'p0', k FROM callable_before WHERE k % 7 = 0), y AS (SELECT 'r' || k % 3 AS rule, 'p' || k % 2 AS property, k AS target FROM callable_after),
    z AS (SELECT x.*, m.target AS moved FROM x LEFT JOIN mapped m ON m.source = x.target), a AS (SELECT rule || '|' || property || '|' || moved AS key, count(*) AS a FROM z WHERE moved IS NOT NULL GROUP BY 1), b AS (SELECT rule || '|' || property || '|' || target AS key, count(*) AS b FROM y GROUP BY 1)
    SELECT key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a > 1 OR b > 1 THEN 'ambiguous' ELSE 'corresponds' END AS status FROM a FULL JOIN b USING (key)
    UNION ALL SELECT rule || '|' || property || '|' || target, 'mapping_unresolved' FROM z WHERE moved IS NULL""", "callable_before", "callable_after")
def obligation_correspondence(spark, sf_dir, v):
    made = lambda d: d.select(F.col("k").alias("id"), F.expr("concat('r', k % 3)").alias("rule"), F.expr("concat('p', k % 2)").alias("property"), F.col("k").alias("target"))
    before = v("callable_before")
    twice = before.where("k % 7 = 0").select(F.col("k").alias("id"), F.lit("r0").alias("rule"), F.lit("p0").alias("property"), F.col("k").alias("target"))
    mapped = before.select(F.col("k").alias("source"), (F.col("k") + 5000000).alias("target")).join(v("callable_after").select(F.col("k").alias("target")), "target", "left_semi")
    return mapping.correspondence(made(before).union(twice), made(v("callable_after")), mapped)


@query("SELECT b.k + 5000000 AS k, b.signature FROM callable_before b JOIN callable_after a ON a.k = b.k + 5000000 WHERE a.signature = b.signature", "callable_before", "callable_after")
def preserved_rows(spark, sf_dir, v):
    b, a = v("callable_before"), v("callable_after")
    mapped = b.select(F.col("k").alias("source"), (F.col("k") + 5000000).alias("target"), F.col("signature").alias("old")).join(a.select(F.col("k").alias("target"), "signature"), "target")
    mapped = mapped.select("source", "target", F.when(F.col("old") == F.col("signature"), "preserved").otherwise("modified").alias("status"))
    return mapping.preserved(mapped, b.select("k", "signature"))


@query("""+x AS (SELECT claim AS unit, min(property) AS a, count(*) AS b FROM bound WHERE relation = 'supports' GROUP BY claim), y AS (SELECT claim AS unit, min(property) AS a, count(*) AS b FROM bound WHERE relation = 'reproduces' GROUP BY claim)
    SELECT unit, CASE WHEN x.b IS NULL THEN 'missing_supports' WHEN y.b IS NULL THEN 'missing_reproduces' WHEN x.a <> y.a THEN 'a_differs' WHEN x.b <> y.b THEN 'b_differs' ELSE 'compatible' END AS outcome FROM x FULL JOIN y USING (unit)""", "bound")
def arm_compatibility(spark, sf_dir, v):
    rows = v("bound").where("relation <> 'contradicts'").groupBy(F.col("claim").alias("unit"), "relation").agg(F.min("property").alias("a"), F.count(F.lit(1)).alias("b"))
    return mapping.pair_compatibility(rows, ["unit"], "relation", ("supports", "reproduces"), ["a", "b"])


@query("""+e AS (SELECT claim, evidence AS m, relation = 'supports' AND evidence % 3 = 0 AS weak FROM bound), g AS (SELECT m, count(*) AS n, bool_or(weak) AS weak FROM e GROUP BY m)
    SELECT * FROM (SELECT coalesce(k, m) AS k, CASE WHEN m IS NULL THEN 'uncovered' WHEN k IS NULL THEN 'unknown_member' WHEN n > 1 THEN 'covered_twice' WHEN weak THEN 'decisive_without_proof' END AS problem
    FROM (SELECT k FROM artifact WHERE k % 5 <> 1) a FULL JOIN g ON k = m) WHERE problem IS NOT NULL""", "bound", "artifact")
def assessment_cover(spark, sf_dir, v):
    entries = v("bound").select(F.array("evidence").alias("members"), (F.col("relation") == "supports").alias("decisive"), (F.col("evidence") % 3).alias("evidence"), F.lit(1).alias("verification"))
    return mapping.exact_cover(entries, v("artifact").where("k % 5 <> 1").select("k"), "k")


@query("""+cb AS (SELECT src AS symbol, dst AS change FROM external_call), s AS (SELECT k AS symbol FROM artifact WHERE public), c AS (SELECT k AS change FROM side_effect)
    SELECT symbol, change, CASE WHEN symbol NOT IN (SELECT symbol FROM s) THEN 'symbol_missing' WHEN change NOT IN (SELECT change FROM c) THEN 'change_missing'
    WHEN EXISTS (SELECT 1 FROM module_edge x JOIN module_edge y USING (container) WHERE x.member = cb.symbol AND y.member = cb.change) THEN 'bridged' ELSE 'candidate' END AS outcome FROM cb""", "external_call", "artifact", "side_effect", "module_edge")
def bridge_mismatches(spark, sf_dir, v):
    edges = v("external_call").select(F.col("src").alias("symbol"), F.col("dst").alias("change"))
    return mapping.bridge(edges, v("artifact").where("public").select(F.col("k").alias("symbol")), v("side_effect").select(F.col("k").alias("change")), v("module_edge"))


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN src % 2 = 1 THEN 'symbol_missing' WHEN dst NOT IN (SELECT k FROM side_effect) THEN 'change_missing' WHEN EXISTS (SELECT 1 FROM module_edge x JOIN module_edge y USING (container) WHERE x.member = src AND y.member = dst) THEN 'bridged' ELSE 'candidate' END AS outcome FROM external_call) GROUP BY 1", "external_call", "side_effect", "module_edge")
def bridge_histogram(spark, sf_dir, v):
    from .registry import QUERIES

    return QUERIES["bridge_mismatches"](spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_CARGO = """SELECT s_nationkey, to_json(named_struct('packages', collect_list(named_struct('name', s_name, 'manifest_path', concat('crates/', s_suppkey, '/Cargo.toml'), 'dependencies',
    array(named_struct('name', concat('Supplier#', lpad(CAST(s_suppkey + 1 AS STRING), 9, '0')), 'path', concat('crates/', s_suppkey + 1)), named_struct('name', 'serde', 'path', CAST(NULL AS STRING))))))) AS raw FROM supplier GROUP BY s_nationkey"""


@query("""WITH e AS (SELECT s_name AS package, 'Supplier#' || lpad((s_suppkey + 1)::VARCHAR, 9, '0') AS needs, s_suppkey + 1 AS k FROM supplier UNION ALL SELECT s_name, 'serde', NULL FROM supplier)
    SELECT package, needs, CASE WHEN needs = 'serde' THEN 'registry' WHEN k IN (SELECT s_suppkey FROM supplier) THEN 'local' ELSE 'local_manifest_missing' END AS outcome, CASE WHEN k IN (SELECT s_suppkey FROM supplier) THEN 'crates/' || k || '/Cargo.toml' END AS manifest FROM e""")
def package_dependencies(spark, sf_dir, v):
    raw = spark.sql(f"WITH supplier AS (SELECT * FROM parquet.`{sf_dir}/supplier.parquet`) {_CARGO}")
    return mapping.dependencies(*stores.packages(raw, "raw"))


@query("""+x AS (SELECT k, '{"id":"' || id || '","status":"' || status || '"}' AS ci, '{"id":"' || id || '","status":"' || status || '","weight":' || weight::DOUBLE || '}' AS human, '{"id":"' || id || '","status":"' || status || '","stream":' || stream || ',"weight":' || weight::DOUBLE || '}' AS ai FROM obligation)
    SELECT k, 'ci' AS projection, ci AS report, 'stream,weight' AS loss FROM x UNION ALL SELECT k, 'human', human, 'stream' FROM x UNION ALL SELECT k, 'ai', ai, '' FROM x UNION ALL SELECT k, 'audit', ai, '' FROM x""", "obligation")
def report_projections(spark, sf_dir, v):
    rows = v("obligation").withColumn("weight", F.col("weight").cast("double"))
    return reporting.projections(rows, "k", ["id", "status", "stream", "weight"])


@query(f"""+l AS (SELECT CASE WHEN {_CLASS.format('path')} NOT IN ('production', 'test') THEN 'path_profile' WHEN {_CLASS.format('path')} = 'test' THEN 'test_path' WHEN k NOT IN (SELECT member FROM module_edge) THEN 'unknown_scope' WHEN end_line - start_line < 5 THEN 'missing_shape' ELSE 'eligible' END AS reason FROM artifact)
    SELECT reason, count(l.reason) AS n FROM (VALUES ('path_profile'), ('test_path'), ('unknown_scope'), ('missing_shape'), ('missing_signals'), ('eligible')) x(reason) LEFT JOIN l USING (reason) GROUP BY reason""", "artifact", "module_edge")
def exclusion_denominators(spark, sf_dir, v):
    owned = v("module_edge").select(F.col("member").alias("k"), F.lit(True).alias("owned")).distinct()
    kind = scalar.path_class(F.col("path"))
    ladder = [("path_profile", ~kind.isin("production", "test")), ("test_path", kind == "test"), ("unknown_scope", F.col("owned").isNull()), ("missing_shape", F.col("end_line") - F.col("start_line") < 5), ("missing_signals", F.lit(False))]
    return reporting.denominators(v("artifact").join(owned, "k", "left"), ladder)


@query("""+p AS (SELECT caller AS a, callee AS b, caller % 17 + callee % 5 AS matches, callee % 11 AS operations FROM calls)
    SELECT *, row_number() OVER (ORDER BY matches DESC, operations DESC, a, b) AS rank FROM p""", "calls")
def signal_ranks(spark, sf_dir, v):
    pairs = v("calls").select(F.col("caller").alias("a"), F.col("callee").alias("b"), (F.col("caller") % 17 + F.col("callee") % 5).alias("matches"), (F.col("callee") % 11).alias("operations"))
    return reporting.signal_ranks(pairs, "matches", "operations", ["a", "b"])


@query("""+b AS (SELECT callee % 50 AS file, resolution AS reason, caller % 3 AS call_kind, substr(sha256((caller * 100000 + callee)::VARCHAR), 1, 2) AS p, (caller * 100000 + callee)::VARCHAR AS id FROM calls WHERE resolution <> 'syntactic_unique'),
    d AS (SELECT file, call_kind, reason, p, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS d FROM b GROUP BY ALL) SELECT file, call_kind, reason, sum(n)::BIGINT AS n, sha256(string_agg(d, ',' ORDER BY p)) AS ids FROM d GROUP BY ALL""", "calls")
def unresolved_summaries(spark, sf_dir, v):
    rows = v("calls").where("resolution <> 'syntactic_unique'").select((F.col("callee") % 50).alias("file"), (F.col("caller") % 3).alias("call_kind"), F.col("resolution").alias("reason"), (F.col("caller") * 100000 + F.col("callee")).alias("id"))
    return reporting.unresolved(rows, ["file", "call_kind", "reason"], "id")


@query("SELECT count(*) AS ids, count(*) > 1000 AS over FROM (SELECT k FROM artifact UNION SELECT k FROM side_effect UNION SELECT k FROM change UNION SELECT k FROM obligation UNION SELECT claim FROM claim)", "artifact", "side_effect", "change", "obligation", "claim")
def known_ids(spark, sf_dir, v):
    sides = [v(n).select("k") for n in ("artifact", "side_effect", "change", "obligation")] + [v("claim").select(F.col("claim").alias("k"))]
    return reporting.capped_union(sides, "k", 1000)


@query("""+m AS (SELECT DISTINCT container, member % 500 AS m FROM module_edge), c AS (SELECT DISTINCT container FROM m), p AS (SELECT x.container AS a, y.container AS b FROM c x JOIN c y ON x.container < y.container)
    SELECT a, b, (SELECT count(*) FROM m x JOIN m y ON x.m = y.m WHERE x.container = a AND y.container = b) AS shared FROM p""", "module_edge")
def context_overlaps(spark, sf_dir, v):
    m = v("module_edge").select("container", (F.col("member") % 500).alias("m"))
    c = m.select("container").distinct()  # modules: some tens
    pairs = c.select(F.col("container").alias("a")).join(c.select(F.col("container").alias("b")), F.col("a") < F.col("b"))
    return reporting.overlap(m, "container", "m", pairs)


@query(_TERMS + f", q AS (SELECT term FROM {_ASKED}), h AS (SELECT id, list_sort(list(term)) AS m FROM p WHERE term IN (SELECT term FROM q) GROUP BY id) SELECT id, array_to_string(m, ',') AS matched, array_to_string(list_sort(list_filter((SELECT list(term) FROM q), lambda x: NOT list_contains(m, x))), ',') AS unmatched FROM h")
def query_term_difference(spark, sf_dir, v):
    return reporting.term_difference(_posted(spark, sf_dir), _QUERY)


@query("""+i AS (SELECT claim FROM bound WHERE evidence % 3 = 0), n AS (SELECT claim, count(*) AS n FROM i GROUP BY claim), e AS (SELECT DISTINCT claim, true AS e FROM claim WHERE claim % 4 <> 2)
    SELECT * FROM (SELECT claim, CASE WHEN n IS NULL THEN 'missing' WHEN e IS NULL THEN 'unknown' WHEN n > 1 THEN 'repeated' END AS problem FROM e FULL JOIN n USING (claim)) WHERE problem IS NOT NULL""", "bound", "claim")
def adjudication_bijection(spark, sf_dir, v):
    return reporting.bijection(v("claim").where("claim % 4 <> 2"), v("bound").where("evidence % 3 = 0"), "claim")


@query("""+h AS (SELECT finding FROM finding f JOIN root_span r ON f.path = r.path AND f.tag = r.tag AND f.s <= r.e AND r.s <= f.e GROUP BY finding HAVING count(DISTINCT root) = 1)
    SELECT DISTINCT finding FROM finding WHERE finding NOT IN (SELECT finding FROM h)""", "finding", "root_span")
def open_adjudications(spark, sf_dir, v):
    from .operators import resolve

    return reporting.needs_adjudication(resolve.overlapping(v("finding"), v("root_span")), v("finding"))


@query("SELECT deferred, applicable, CASE WHEN deferred * 20 <= applicable THEN 'pass' ELSE 'blocked' END AS gate FROM (SELECT count(*) FILTER (status = 'P') AS deferred, count(*) FILTER (status <> 'P') AS applicable FROM obligation)", "obligation")
def deferral_gate(spark, sf_dir, v):
    return reporting.deferral(v("obligation"), F.col("status") == "P", F.col("status") != "P")


@query("SELECT * , n <= most AS within FROM (SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n, 10000::BIGINT AS most UNION ALL SELECT 'part', (SELECT count(*) FROM part), 5000::BIGINT UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 65536::BIGINT)")
def row_limits(spark, sf_dir, v):
    return reporting.row_limits({n: table(spark, sf_dir, n) for n in ("orders", "part", "lineitem")}, {"orders": 10000, "part": 5000, "lineitem": 65536})


@query("""+d(property, verifier, deferred) AS (VALUES ('p0', 'static', false), ('p1', 'static', false), ('p1', 'dynamic', true), ('p2', 'dynamic', true))
    SELECT claim AS id, verifier, CASE WHEN verifier IS NULL THEN 'none' WHEN deferred THEN 'unsupported' ELSE 'applicable' END AS state FROM claim LEFT JOIN d USING (property)""", "claim")
def verifier_plan(spark, sf_dir, v):
    dim = spark.createDataFrame([("p0", "static", False), ("p1", "static", False), ("p1", "dynamic", True), ("p2", "dynamic", True)], "property string, verifier string, deferred boolean")
    return reporting.verifier_plan(v("claim").select(F.col("claim").alias("id"), "property"), dim)


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def observation_split(spark, sf_dir, v):
    return reporting.observations(table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"), "user_id", ["signup", "view", "click", "purchase"])


_CHANGE_ROWS = "SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'R' WHEN 3 THEN 'C' WHEN 4 THEN 'X' WHEN 5 THEN NULL ELSE 'D' END AS status, CASE WHEN p_partkey % 13 <> 0 THEN concat('src/', p_partkey, '.rs') ELSE '' END AS path, CASE WHEN p_partkey % 3 = 0 THEN concat('old/', p_partkey, '.rs') END AS old_path FROM part"


@query(f"SELECT k FROM ({_CHANGE_ROWS}) WHERE path <> '' AND (status IN ('A', 'M', 'D') AND old_path IS NULL OR status IN ('R', 'C') AND old_path IS NOT NULL)")
def valid_changes(spark, sf_dir, v):
    rows = spark.sql(f"WITH part AS (SELECT * FROM parquet.`{sf_dir}/part.parquet`) {_CHANGE_ROWS}")
    return rows.where(reporting.valid_change(rows)).select("k")


@query("""SELECT s_nationkey AS g, CASE WHEN s_suppkey % 9 = 0 THEN '120000' WHEN s_suppkey % 4 = 0 THEN '100755' ELSE '100644' END AS mode, 'blob' AS type, sha256(s_name) AS oid, 'src/' || s_name || '.rs' AS path, s_suppkey % 9 <> 0 AS regular FROM supplier""")
def tree_listing(spark, sf_dir, v):
    entry = F.expr("concat(CASE WHEN s_suppkey % 9 = 0 THEN '120000' WHEN s_suppkey % 4 = 0 THEN '100755' ELSE '100644' END, ' blob ', sha2(s_name, 256), '\\t', 'src/', s_name, '.rs')")
    raw = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.concat(F.array_join(F.collect_list(entry), "\0"), F.lit("\0")).alias("raw"))
    return listings.parse_tree(raw, "raw", "g")


@query("""SELECT CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'R' WHEN 2 THEN 'M' ELSE 'C' END AS status, CASE WHEN p_partkey % 2 = 1 THEN 'old/A' || p_partkey ELSE 'new/R' || p_partkey END AS old_path, 'new/R' || p_partkey AS path FROM part""")
def name_status(spark, sf_dir, v):
    entry = F.expr("concat_ws('\\0', CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'R097' WHEN 2 THEN 'M' ELSE 'C100' END, CASE WHEN p_partkey % 2 = 1 THEN concat('old/A', p_partkey) END, concat('new/R', p_partkey))")
    raw = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.array_join(F.collect_list(entry), "\0"), F.lit("\0")).alias("raw"))
    return listings.parse_changes(raw, "raw")


def _patches(v) -> DataFrame:
    hunk = F.expr("concat('@@ -1,0 +', greatest(s, 1), ',', e - greatest(s, 1) + 1, ' @@\n+x')")
    gone = F.expr("concat('@@ -', n, ',2 +', n, ',0 @@\n-y')")
    rows = v("hunk").select("path", hunk.alias("h")).union(v("deletion").select("path", gone.alias("h")))
    return rows.groupBy("path").agg(F.concat(F.lit("diff --git a b\n--- a/"), F.first("path"), F.lit("\n+++ b/"), F.first("path"), F.lit("\n"), F.array_join(F.collect_list("h"), "\n"), F.lit("\n")).alias("patch"))


@query("SELECT DISTINCT path, unnest(range(greatest(s, 1), e + 1))::INT AS line FROM hunk", "hunk")
def changed_lines(spark, sf_dir, v):
    return listings.changed_lines(listings.split_patches(_patches(v).select(F.col("patch").alias("raw")), "raw"), "patch", "path")


@query("SELECT doc_id, CASE WHEN m = 0 THEN 'not_json' WHEN m = 1 THEN 'field_missing' ELSE 'accepted' END AS status FROM (SELECT doc_id, doc_id % 3 AS m FROM documents)")
def strict_json(spark, sf_dir, v):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.expr("""CASE doc_id % 3 WHEN 0 THEN concat('{"id": ', doc_id, ', "lang": ') WHEN 1 THEN concat('{"id": ', doc_id, '}') ELSE concat('{"id": ', doc_id, ', "lang": "', lang, '"}') END""").alias("raw"))
    return stores.strict(raw, "doc_id", "raw", "id long, lang string").select("doc_id", "status")


@query("""WITH w AS (SELECT user_id AS stream, event_id AS n, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS last, event_id % 11 = 5 AS bad, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
    SELECT stream, n, CASE WHEN bad AND last THEN 'torn_tail' WHEN bad THEN 'corrupt' WHEN p IS NOT NULL AND p % 11 <> 5 AND n % 10 = 0 THEN 'chain_broken' ELSE 'ok' END AS status FROM w""")
def journal_scan(spark, sf_dir, v):
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("n"), F.when(F.col("event_id") % 10 == 0, -1).otherwise(before).alias("p"))
    line = F.when(F.col("n") % 11 == 5, F.concat(F.lit('{"seq": '), F.col("n"))).otherwise(F.to_json(F.struct(F.col("n").alias("seq"), F.col("n").cast("string").alias("hash"), F.col("p").cast("string").alias("prev"))))
    return stores.journal(rows.withColumn("line", line), "stream", "n", "line")


@query("SELECT sha256(text) AS sha256, max(strlen(text))::BIGINT AS bytes, true AS intact FROM documents WHERE text IS NOT NULL GROUP BY 1")
def object_store(spark, sf_dir, v):
    return stores.verified_objects(stores.put_objects(table(spark, sf_dir, "documents"), "text"))


@query("SELECT status, count(*) AS n FROM obligation GROUP BY status UNION ALL SELECT relation, count(*) FROM binding GROUP BY relation", "obligation", "binding")
def rebuilt_index(spark, sf_dir, v):
    made = stores.rebuild_index(spark, {"obligations": v("obligation"), "bindings": v("binding")})
    return made["obligations"].groupBy("status").agg(F.count(F.lit(1)).alias("n")).union(made["bindings"].groupBy("relation").agg(F.count(F.lit(1))))


@query("SELECT url AS name, strlen(html)::BIGINT AS bytes, sha256(html) AS sha256 FROM pages")
def artifact_manifest(spark, sf_dir, v):
    return stores.manifest(table(spark, sf_dir, "pages"), "url", "html")


@query("SELECT stream, '## Stream ' || stream || chr(10) || chr(10) || string_agg('- ' || id || ': ' || status, chr(10) ORDER BY k) AS markdown FROM obligation GROUP BY stream", "obligation")
def markdown_reports(spark, sf_dir, v):
    return stores.markdown(v("obligation"), "stream", F.concat(F.lit("Stream "), F.col("stream")), F.concat("id", F.lit(": "), "status"), F.col("k"))


@query("SELECT c_custkey AS id, 'acctbal' AS field, c_acctbal::VARCHAR AS value FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def migration_losses(spark, sf_dir, v):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return stores.migrate(rows, "id", {"name": "label"}, {"version": F.lit(2)}, ["acctbal", "segment"])[1]


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'unsupported_entry' WHEN p_type = 'ECONOMY' THEN 'profile_excluded' WHEN p_size > 40 THEN 'unread_bound' WHEN p_size % 6 = 0 THEN 'parse_failed' ELSE 'parsed' END AS outcome FROM part) GROUP BY 1""")
def file_inventory(spark, sf_dir, v):
    rows = stores.inventory(table(spark, sf_dir, "part"), F.col("p_partkey") % 9 != 0, F.col("p_type") == "ECONOMY", F.col("p_size") > 40, F.col("p_size") % 6 == 0)
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_ODD = """SELECT k, label, CASE k % 12 WHEN 5 THEN concat('../', path) WHEN 6 THEN concat(path, '/') WHEN 7 THEN replace(path, '.rs', '.kt') WHEN 8 THEN replace(path, '.rs', '.tsx') WHEN 10 THEN replace(path, 'src/', 'src/./') ELSE path END AS path,
    CASE k % 10 WHEN 3 THEN upper(id) WHEN 4 THEN concat(id, ' x') WHEN 6 THEN replace(id, ':', '') ELSE id END AS id FROM"""


@query(f"""SELECT k, path LIKE 'crates/%/src/%.rs' OR path LIKE 'rust/%/src/%.rs' AS production, regexp_matches(path, '(^|/)(tests|benches|benchmarks)/|(^|/)tests?[.]rs$|_tests?[.]rs$') AS test, CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.kt' THEN 'kotlin' WHEN path LIKE '%.tsx' THEN 'typescript' ELSE 'other' END AS language,
    NOT (list_contains(string_split(path, '/'), '..') OR list_contains(string_split(path, '/'), '.') OR list_contains(string_split(path, '/'), '')) AS safe, regexp_matches(id, '^[a-z][a-z0-9._-]*:[!-~]+$') AS valid_id, regexp_replace(trim(label || '  x'), ' +', ' ', 'g') AS label FROM ({_ODD} artifact)""", "artifact")
def path_predicates(spark, sf_dir, v):
    rows, p = spark.sql(f"{_ODD} {{a}}", a=v("artifact")), F.col("path")
    kind = scalar.test_path(p)
    return rows.select("k", scalar.production_path(p).alias("production"), kind.alias("test"), scalar.language(p).alias("language"), scalar.safe_path(p).alias("safe"), scalar.valid_stable_id(F.col("id")).alias("valid_id"), scalar.normal_space(F.concat("label", F.lit("  x"))).alias("label"))


@query("SELECT event_id, d > 3 AS too_deep, d::INT AS depth FROM (SELECT event_id, greatest(1, event_id % 6) AS d FROM events)")
def nesting_guard(spark, sf_dir, v):
    text = F.expr("concat(repeat('{[', CAST((event_id % 6) div 2 AS INT)), CASE WHEN event_id % 2 = 1 THEN '(x)' ELSE 'x' END, repeat(']}', CAST((event_id % 6) div 2 AS INT)), '()' )")
    depth = scalar.nesting_depth(text)
    return table(spark, sf_dir, "events").select("event_id", (depth > 3).alias("too_deep"), depth.alias("depth"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'http,parse' || s_suppkey || ',server' ELSE 'file,parse' || s_suppkey || ',reader' END AS words FROM supplier""")
def camel_case_words(spark, sf_dir, v):
    name = F.expr("concat('parse', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'HTTPServer' ELSE '_fileReader' END)")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.array_join(scalar.identifier_words(name), ",").alias("words"))


@query("SELECT k, label LIKE '%ring' AS hit FROM artifact", "artifact")
def label_suffixes(spark, sf_dir, v):
    return v("artifact").select("k", scalar.label_suffix(F.concat(F.lit("crate::"), F.regexp_replace("label", " ", "::")), F.lit("ring")).alias("hit"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def attribute_values(spark, sf_dir, v):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", scalar.attribute(props, "k").cast("long").alias("k"))
