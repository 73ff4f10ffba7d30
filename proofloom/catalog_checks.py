"""Queries of the small checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import checks
from .registry import query, table


@query("SELECT count(*) FILTER (status = 'P') AS excluded, coalesce(sum(CASE WHEN status = 'P' THEN weight::DECIMAL(18, 6) END), 0)::DOUBLE AS weight FROM obligation", "obligation")
def excluded_weight(spark, sf_dir, v):
    return checks.excluded_weight(v("obligation"), F.col("status") == "P")


@query("SELECT stream % 10 AS stage, round(sum(CASE WHEN status = 'F' THEN weight::DECIMAL(18, 6) ELSE 0 END)::DOUBLE / sum(weight::DECIMAL(18, 6))::DOUBLE, 6) AS ratio FROM obligation GROUP BY 1", "obligation")
def visited_stages(spark, sf_dir, v):
    return checks.visited_share(v("obligation").withColumn("stage", F.col("stream") % 10), "stage", F.col("status") == "F")


@query("SELECT DISTINCT s_suppkey AS limitation FROM supplier WHERE s_suppkey % 4 IN (1, 2)")
def touching_limitations(spark, sf_dir, v):
    names = F.expr("CASE s_suppkey % 4 WHEN 0 THEN array('ast') WHEN 1 THEN array('ast', 'direct_calls') WHEN 2 THEN array('concurrency_model', 'direct_calls') ELSE array('containment', 'ast') END")
    return checks.touching_limitations(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("limitation"), names.alias("names")), v("capability").where("state <> 'complete'"))


@query("""+m AS (SELECT DISTINCT c_mktsegment AS context, c_nationkey AS member FROM customer), w AS (SELECT DISTINCT s_suppkey % 20 AS item, s_nationkey AS member FROM supplier)
    SELECT context, item FROM (SELECT DISTINCT context FROM m) c, (SELECT DISTINCT item FROM w) i WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.item = i.item AND NOT EXISTS (SELECT 1 FROM m WHERE m.context = c.context AND m.member = w.member))""".replace("+m", "WITH m"))
def covering_contexts(spark, sf_dir, v):
    members = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("context"), F.col("c_nationkey").alias("member"))
    return checks.covering(members, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("item"), F.col("s_nationkey").alias("member")))


@query("SELECT 'claim' AS reference, count(*) AS n FROM bound WHERE claim NOT IN (SELECT finding_id FROM fnd) UNION ALL SELECT 'evidence', count(*) FROM bound WHERE evidence NOT IN (SELECT evidence FROM evid)", "bound", "fnd", "evid")
def dangling_references(spark, sf_dir, v):
    return checks.dangling(v("bound"), {"claim": (v("fnd"), "finding_id"), "evidence": (v("evid"), "evidence")})


@query("SELECT k, id, status FROM obligation WHERE k IN (SELECT claim FROM fnd)", "obligation", "fnd")
def selected_rows(spark, sf_dir, v):
    return checks.selected(v("obligation"), v("fnd").withColumnRenamed("claim", "k"), "k").select("k", "id", "status")


@query("SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT callee FROM calls WHERE resolution = 'syntactic_unique' INTERSECT SELECT callee FROM calls WHERE resolution <> 'syntactic_unique')", "calls")
def layers_disjoint(spark, sf_dir, v):
    return checks.shared_ids(v("calls").where("resolution = 'syntactic_unique'"), v("calls").where("resolution <> 'syntactic_unique'"), "callee")


@query("SELECT DISTINCT k AS pair, evidence AS section, k % 7 AS anchor FROM binding WHERE k % 4 <> 0", "binding")
def section_restrictions(spark, sf_dir, v):
    b = v("binding").select(F.col("k").alias("pair"), F.col("evidence").alias("section")).distinct()
    return checks.restrictions(b, b.where("pair % 4 <> 0").select("pair", (F.col("pair") % 7).alias("anchor")).distinct())


@query("SELECT obligation, string_agg(DISTINCT x, ',' ORDER BY x) AS trace FROM (SELECT obligation, unnest([relation, b.property]) AS x FROM claim JOIN bound b USING (claim)) GROUP BY obligation", "claim", "bound")
def section_traces(spark, sf_dir, v):
    rows = v("claim").select("claim", "obligation").join(v("bound").select("claim", F.array("relation", "property").alias("items")), "claim")
    return checks.traces(rows, "obligation", "items")


@query("SELECT claim, decision_id FROM verdict WHERE claim NOT IN (SELECT claim FROM verif WHERE passed)", "verdict", "verif")
def open_executions(spark, sf_dir, v):
    return checks.open_executions(v("verdict").select("claim", "decision_id"), v("verif").where("passed"), "claim")


@query("""+s AS (SELECT claim AS family, count(*) AS n, count(DISTINCT property) AS d, max(evidence) % 5 AS e, min(evidence) % 4 AS f FROM bound GROUP BY claim)
    SELECT family, unnest(list_filter([CASE WHEN n <> d THEN 'member_repeated' END, CASE WHEN d <> 3 THEN 'denominator_differs' END, CASE WHEN e = 0 THEN 'evidence_missing' END, CASE WHEN f = 0 THEN 'verification_missing' END], lambda x: x IS NOT NULL)) AS fault FROM s""", "bound")
def family_faults(spark, sf_dir, v):
    b = v("bound")
    families = b.groupBy(F.col("claim").alias("family")).agg((F.max("evidence") % 5).alias("evidence"), (F.min("evidence") % 4).alias("verification")).withColumn("declared", F.lit(3))
    return checks.family_faults(families, b.select(F.col("claim").alias("family"), F.col("property").alias("member")))


@query("""WITH i AS (SELECT p_partkey AS id, 'f' || p_partkey % 30 AS file, 'n' || p_size % 12 AS name FROM part), e AS (SELECT DISTINCT 'f' || s_suppkey % 30 AS file, 'n' || s_nationkey % 12 AS name, 'l' || s_suppkey % 9 AS local FROM supplier),
    d AS (SELECT 'f' || s_suppkey % 30 AS file, 'l' || s_suppkey % 9 AS name, s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT id, CASE WHEN s = 1 AND n = 1 THEN k END AS declaration, CASE WHEN s IS NULL THEN 'export_binding_unsupported' WHEN s > 1 THEN 'import_binding_ambiguous' WHEN n IS NULL OR n <> 1 THEN 'unresolved_name' ELSE 'bound' END AS outcome
    FROM i LEFT JOIN (SELECT file, name, count(*) AS s, min(local) AS local FROM e GROUP BY 1, 2) x USING (file, name) LEFT JOIN (SELECT file AS df, name AS dn, count(*) AS n, min(k) AS k FROM d GROUP BY 1, 2) y ON df = file AND dn = local""")
def import_bindings(spark, sf_dir, v):
    s = table(spark, sf_dir, "supplier")
    file, local = F.expr("concat('f', s_suppkey % 30)").alias("file"), F.expr("concat('l', s_suppkey % 9)")
    imports = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("concat('f', p_partkey % 30)").alias("file"), F.expr("concat('n', p_size % 12)").alias("name"))
    return checks.bindings(imports, s.select(file, F.expr("concat('n', s_nationkey % 12)").alias("name"), local.alias("local")).distinct(), s.where("s_suppkey % 5 <> 0").select(file, local.alias("name"), F.col("s_suppkey").alias("k")))


@query("SELECT DISTINCT k FROM callable_after c WHERE EXISTS (SELECT 1 FROM deletion d WHERE d.path = c.path AND d.n BETWEEN c.s AND c.e)", "callable_after", "deletion")
def callables_on_lines(spark, sf_dir, v):
    return checks.meets_lines(v("callable_after"), v("deletion").withColumnRenamed("n", "line"))
