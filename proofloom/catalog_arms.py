"""Queries of trials: an order is a trial, four orders a pair of two arms and two roles, its lines the findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import arms
from .registry import query, table
from .store import written

_TRIALS = """WITH t AS (SELECT o_orderkey AS trial, o_orderkey // 4 AS pair, o_orderkey // 4 AS unit, CASE o_orderkey % 2 WHEN 0 THEN 'b1' ELSE 'g3' END AS arm, CASE o_orderkey // 2 % 2 WHEN 0 THEN 'positive' ELSE 'control' END AS role FROM orders),
    z AS (SELECT *, CASE WHEN trial % 37 = 5 THEN 'missing_collection' WHEN trial % 41 = 6 THEN 'protocol_invalid' WHEN trial % 43 = 7 THEN 'collection_binding_invalid' WHEN trial % 47 = 8 THEN 'missing_score' WHEN trial % 53 = 9 THEN 'score_binding_invalid' END AS reason FROM t)"""
_SCORES = _TRIALS + """, l AS (SELECT DISTINCT l_orderkey AS trial, l_orderkey // 4 AS unit, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, l_partkey % 5 AS path, l_suppkey % 40 AS s, l_suppkey % 40 + l_linenumber AS e, l_returnflag AS tag FROM lineitem),
    f AS (SELECT l.* FROM l JOIN t USING (trial)), ro AS (SELECT * FROM l WHERE trial % 4 = 1), an AS (SELECT * FROM l WHERE trial % 4 <> 1),
    hr AS (SELECT DISTINCT f.trial, f.id, x.id AS target FROM f JOIN ro x ON x.unit = f.unit AND x.path = f.path AND x.tag = f.tag AND f.s <= x.e AND x.s <= f.e),
    ha AS (SELECT DISTINCT f.trial, f.id FROM f JOIN an x ON x.unit = f.unit AND x.path = f.path AND x.tag = f.tag AND f.s <= x.e AND x.s <= f.e),
    sc AS (SELECT t.trial, role, coalesce(n, 0) AS findings, coalesce(m, 0) AS matched, coalesce(d, 0) AS detected, CASE role WHEN 'positive' THEN coalesce(n, 0) - coalesce(m, 0) ELSE coalesce(n, 0) END AS unlabeled, CASE role WHEN 'positive' THEN 0 ELSE coalesce(a, 0) END AS allegations
      FROM t LEFT JOIN (SELECT trial, count(DISTINCT id) AS n FROM f GROUP BY 1) USING (trial) LEFT JOIN (SELECT trial, count(DISTINCT id) AS m FROM (SELECT trial, id FROM hr UNION SELECT trial, id FROM ha) GROUP BY 1) USING (trial)
      LEFT JOIN (SELECT trial, count(DISTINCT target) AS d FROM hr GROUP BY 1) USING (trial) LEFT JOIN (SELECT trial, count(*) AS a FROM ha GROUP BY 1) USING (trial))"""


def _trials(spark, sf_dir):
    k = F.col("o_orderkey")
    unit = F.expr("o_orderkey div 4")
    arm, role = F.when(k % 2 == 0, "b1").otherwise("g3"), F.when(F.expr("o_orderkey div 2 % 2") == 0, "positive").otherwise("control")
    return table(spark, sf_dir, "orders").select(k.alias("trial"), unit.alias("pair"), unit.alias("unit"), arm.alias("arm"), role.alias("role"), F.concat(F.lit("in"), k).alias("input_hash"))


def _scored(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS trial", "l_orderkey div 4 AS unit", "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id", "l_partkey % 5 AS path", "l_suppkey % 40 AS s", "l_suppkey % 40 + l_linenumber AS e", "l_returnflag AS tag")
    lines = written(lines.distinct(), "lines")
    target = lambda p: lines.where(p).select("unit", F.col("id").alias("target"), "path", "s", "e", "tag")
    return arms.scored(_trials(spark, sf_dir), lines.drop("unit").withColumnRenamed("id", "finding"), target("trial % 4 = 1"), target("trial % 4 <> 1"))


def _reasoned(spark, sf_dir):
    """Planted: collections and scores that are missing, invalid, or of another input or output."""
    inventory = _trials(spark, sf_dir)
    made = inventory.where("trial % 37 <> 5").select("trial", (F.col("trial") % 41 != 6).alias("valid"), F.when(F.col("trial") % 43 == 7, "other").otherwise(F.col("input_hash")).alias("input_hash"), F.concat(F.lit("out"), "trial").alias("output_hash"))
    given = inventory.where("trial % 47 <> 8").select("trial", F.concat(F.when(F.col("trial") % 53 == 9, "old").otherwise("out"), F.col("trial")).alias("output_hash"))
    return arms.trial_reasons(inventory, made, given)


@query(_TRIALS + " SELECT trial, pair, unit, arm, role, concat('in', trial) AS input_hash, reason FROM z")
def trial_reasons(spark, sf_dir, v):
    return _reasoned(spark, sf_dir)


@query(_TRIALS + " SELECT pair, count(*) AS trials, count(reason) AS excluded, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM z GROUP BY 1")
def pair_eligibility(spark, sf_dir, v):
    return arms.eligible_pairs(_reasoned(spark, sf_dir))


@query(_SCORES + " SELECT trial, findings, matched, detected, unlabeled, allegations FROM sc")
def arm_scores(spark, sf_dir, v):
    return _scored(spark, sf_dir)


@query(_SCORES + """, el AS (SELECT pair FROM z GROUP BY 1 HAVING count(reason) = 0), x AS (SELECT z.*, z.pair IN (SELECT pair FROM el) AS ok, detected, unlabeled, allegations FROM z JOIN sc USING (trial)),
    g AS (SELECT arm, count(*) AS trials, count(*) FILTER (reason IS NULL) AS counted, count(DISTINCT pair) AS pairs, count(DISTINCT pair) FILTER (ok) AS eligible, coalesce(sum(detected) FILTER (ok AND role = 'positive'), 0)::BIGINT AS detected,
      coalesce(sum(unlabeled) FILTER (ok AND role = 'control'), 0)::BIGINT AS unlabeled, coalesce(sum(allegations) FILTER (ok AND role = 'control'), 0)::BIGINT AS allegations FROM x GROUP BY 1)
    SELECT *, (detected - coalesce((SELECT max(detected) FROM g y WHERE y.arm <> g.arm), 0))::BIGINT AS lead FROM g""")
def arm_totals(spark, sf_dir, v):
    return arms.run_totals(_reasoned(spark, sf_dir), _scored(spark, sf_dir))
