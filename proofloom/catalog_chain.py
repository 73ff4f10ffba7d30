"""Queries of the chain from executions to findings and of qualifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import chain
from .registry import query, table

_CHAIN = """+c AS (SELECT claim, claim // 4 AS execution FROM claim), p AS (SELECT claim // 4 AS execution, claim FROM claim WHERE claim % 61 <> 7 UNION SELECT claim // 4, claim + 100000000 FROM claim WHERE claim % 67 = 3),
    b AS (SELECT DISTINCT claim, evidence, CASE WHEN claim % 3 = 0 AND relation <> 'contradicts' THEN 'reproduces' ELSE relation END AS relation FROM bound),
    e AS (SELECT DISTINCT evidence FROM bound WHERE evidence % 50 <> 1), w AS (SELECT DISTINCT claim, evidence FROM b WHERE relation = 'reproduces' AND (claim + evidence) % 41 <> 0 UNION SELECT claim, evidence + 1 FROM b WHERE relation = 'reproduces' AND (claim + evidence) % 53 = 0),
    a AS (SELECT claim, 'verification' AS kind, evidence::VARCHAR AS member FROM w WHERE claim % 29 <> 4 AND (claim % 31 <> 5 OR evidence % 2 = 0) UNION SELECT claim, 'decision', decision_id::VARCHAR FROM verdict WHERE claim % 29 <> 4 AND claim % 37 <> 6
      UNION SELECT claim, 'finding', finding_id::VARCHAR FROM fnd WHERE claim % 29 <> 4 AND claim % 43 <> 8),
    ex AS (SELECT execution FROM (SELECT execution, list_sort(list(DISTINCT claim)) AS x FROM c GROUP BY 1) JOIN (SELECT execution, list_sort(list(DISTINCT claim)) AS y FROM p GROUP BY 1) USING (execution) WHERE x = y),
    r AS (SELECT claim, list_sort(list(DISTINCT evidence)) AS x FROM b WHERE relation = 'reproduces' GROUP BY 1), ok AS (SELECT claim, list_sort(list(DISTINCT evidence)) AS y FROM w GROUP BY 1),
    l AS (SELECT claim, coalesce(list_sort(list(member) FILTER (kind = 'verification')), []) AS v, coalesce(list_sort(list(member) FILTER (kind = 'decision')), []) AS d, coalesce(list_sort(list(member) FILTER (kind = 'finding')), []) AS f FROM a GROUP BY 1),
    tv AS (SELECT claim, list_sort(list(DISTINCT evidence::VARCHAR)) AS v FROM w GROUP BY 1), td AS (SELECT claim, list_sort(list(DISTINCT decision_id::VARCHAR)) AS d FROM verdict GROUP BY 1), tf AS (SELECT claim, list_sort(list(DISTINCT finding_id::VARCHAR)) AS f FROM fnd GROUP BY 1),
    chained AS (SELECT c.claim, CASE WHEN c.execution NOT IN (SELECT execution FROM ex) THEN 'execution' WHEN r.x IS NULL OR c.claim IN (SELECT claim FROM b WHERE evidence NOT IN (SELECT evidence FROM e)) THEN 'binding' WHEN ok.y IS NULL OR x <> y THEN 'verification' WHEN l.claim IS NULL THEN 'assessment'
      WHEN l.v <> coalesce(tv.v, []) THEN 'assessed_verifications' WHEN td.d IS NULL OR l.d <> td.d THEN 'decision' WHEN l.f <> coalesce(tf.f, []) OR c.claim IN (SELECT claim FROM fnd WHERE (claim, decision_id) NOT IN (SELECT claim, decision_id FROM verdict WHERE decision = 'accept')) THEN 'finding' END AS broken
      FROM c LEFT JOIN r USING (claim) LEFT JOIN ok USING (claim) LEFT JOIN l USING (claim) LEFT JOIN tv USING (claim) LEFT JOIN td USING (claim) LEFT JOIN tf USING (claim))"""


def _chained(v):
    claims = v("claim").select("claim", F.expr("claim div 4").alias("execution"))
    parsed = claims.where("claim % 61 <> 7").select("execution", "claim").union(claims.where("claim % 67 = 3").select("execution", F.col("claim") + 100_000_000))
    relation = F.expr("CASE WHEN claim % 3 = 0 AND relation <> 'contradicts' THEN 'reproduces' ELSE relation END")
    bindings = v("bound").select("claim", "evidence", relation.alias("relation"))
    proof = bindings.where("relation = 'reproduces'")
    checked = proof.where("(claim + evidence) % 41 <> 0").select("claim", "evidence").union(proof.where("(claim + evidence) % 53 = 0").select("claim", F.col("evidence") + 1)).withColumn("passed", F.lit(True))
    told = lambda d, kind, c, keep: d.where(f"claim % 29 <> 4 AND {keep}").select("claim", F.lit(kind).alias("kind"), F.col(c).cast("string").alias("member"))
    assessed = told(checked, "verification", "evidence", "(claim % 31 <> 5 OR evidence % 2 = 0)").union(told(v("verdict"), "decision", "decision_id", "claim % 37 <> 6")).union(told(v("fnd"), "finding", "finding_id", "claim % 43 <> 8"))
    return chain.closed_chain(claims, parsed, bindings, v("bound").where("evidence % 50 <> 1").select("evidence"), checked, assessed, v("verdict"), v("fnd"))


@query(_CHAIN + " SELECT claim, broken FROM chained", "claim", "bound", "verdict", "fnd")
def chain_closure(spark, sf_dir, v):
    """Planted: claims that no execution parsed, unknown evidence, evidence without verification, lists of assessments that lack a member."""
    return _chained(v)


@query(_CHAIN + " SELECT coalesce(broken, 'closed') AS hop, count(*) AS claims FROM chained GROUP BY 1", "claim", "bound", "verdict", "fnd")
def chain_hops(spark, sf_dir, v):
    return _chained(v).groupBy(F.coalesce("broken", F.lit("closed")).alias("hop")).agg(F.count(F.lit(1)).alias("claims"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT c_nationkey AS context, concat('o', o_orderkey) AS part FROM customer JOIN orders ON o_custkey = c_custkey), pt AS (SELECT DISTINCT concat('o', l_orderkey) AS section, concat('p', l_partkey) AS part FROM lineitem UNION SELECT concat('p', p_partkey), concat('e', p_partkey % 97) FROM part
      UNION SELECT concat('e', p_partkey % 97), concat('p', p_partkey) FROM part WHERE p_partkey % 97 = p_partkey % 89),
    h AS (SELECT context, part FROM s UNION SELECT context, pt.part FROM h JOIN pt ON pt.section = h.part), d AS (SELECT DISTINCT s_nationkey AS context, concat('p', s_suppkey * 3 % (SELECT count(*) FROM part)) AS qualification FROM supplier UNION SELECT s_nationkey, concat('x', s_suppkey % 5) FROM supplier UNION SELECT s_nationkey, concat('e', s_suppkey % 120) FROM supplier)
    SELECT context, qualification FROM d WHERE qualification NOT IN ('x0', 'x1', 'x2') AND (context, qualification) NOT IN (SELECT context, part FROM h)""")
def qualification_faults(spark, sf_dir, v):
    t = lambda n: table(spark, sf_dir, n)
    sections = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("context"), F.concat(F.lit("o"), "o_orderkey").alias("section"))
    part = lambda a, b: [F.expr(a).alias("section"), F.expr(b).alias("part")]
    parts = t("lineitem").select(*part("concat('o', l_orderkey)", "concat('p', l_partkey)")).union(t("part").select(*part("concat('p', p_partkey)", "concat('e', p_partkey % 97)"))).union(t("part").where("p_partkey % 97 = p_partkey % 89").select(*part("concat('e', p_partkey % 97)", "concat('p', p_partkey)"))).distinct()
    n = t("part").count()
    asked = lambda q: t("supplier").select(F.col("s_nationkey").alias("context"), F.expr(q).alias("qualification"))
    descriptors = asked(f"concat('p', s_suppkey * 3 % {n})").union(asked("concat('x', s_suppkey % 5)")).union(asked("concat('e', s_suppkey % 120)"))
    return chain.qualification_faults(descriptors, spark.createDataFrame([("x0",), ("x1",), ("x2",)], "id string"), sections, parts)
