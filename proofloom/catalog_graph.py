"""Queries over graphs: waves, walks, closures, staleness, components."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from .plans import graph, waves
from .registry import query


def _plan(v):
    rows = v("obligation")
    chained = rows.select("id", F.lag("id").over(Window.partitionBy("stream").orderBy("made_at", "k")).alias("on"))
    return rows.select("id", F.col("weight").cast("double").alias("weight")), chained.where("on IS NOT NULL")


@query("""+l AS (SELECT id, weight, (row_number() OVER (PARTITION BY stream ORDER BY made_at, k) - 1)::INT AS wave FROM obligation)
    SELECT id, wave, (row_number() OVER (PARTITION BY wave ORDER BY weight DESC, id) - 1)::INT AS pos, NULL::VARCHAR AS deferred FROM l""", "obligation")
def review_waves(spark, sf_dir, v):
    longest, n = v("obligation").groupBy("stream").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return waves.waves(*_plan(v), max_waves=longest or 0, per_wave=n or 0)


@query("""+l AS (SELECT id, weight, (row_number() OVER (PARTITION BY stream ORDER BY made_at, k) - 1)::INT AS level FROM obligation)
    SELECT id, CASE WHEN level < 2 THEN level END AS wave, CASE WHEN level < 2 THEN (row_number() OVER (PARTITION BY level ORDER BY weight DESC, id) - 1)::INT END AS pos,
    CASE WHEN level = 2 THEN 'budget_exhausted' WHEN level > 2 THEN 'prerequisite_deferred' END AS deferred FROM l""", "obligation")
def deferred_waves(spark, sf_dir, v):
    n = v("obligation").count()
    return waves.waves(*_plan(v), max_waves=2, per_wave=n)


@query("""+l AS (SELECT id, row_number() OVER (ORDER BY weight DESC, id) - 1 AS r FROM obligation WHERE id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY stream ORDER BY made_at, k) AS n FROM obligation) WHERE n > 1))
    SELECT id, CASE WHEN r < 50 THEN 0 END::INT AS wave, CASE WHEN r < 50 THEN r END::INT AS pos, CASE WHEN r >= 50 THEN 'budget_exhausted' END AS deferred FROM l
    UNION ALL SELECT o.id, NULL, NULL, CASE WHEN p.r < 50 AND o.n = 2 THEN 'budget_exhausted' ELSE 'prerequisite_deferred' END FROM
    (SELECT id, stream, row_number() OVER (PARTITION BY stream ORDER BY made_at, k) AS n, first_value(id) OVER (PARTITION BY stream ORDER BY made_at, k) AS head FROM obligation) o JOIN l p ON p.id = o.head WHERE n > 1""", "obligation")
def capped_wave(spark, sf_dir, v):
    return waves.waves(*_plan(v), max_waves=1, per_wave=50)


@query("""+e AS (SELECT 'contains' AS kind, 'o' || container AS src, 'p' || member AS dst FROM contains UNION ALL SELECT 'calls', 'p' || src, 's' || dst FROM touches_supplier),
    w AS (WITH RECURSIVE r(node, token, rest, depth) AS (SELECT 'o' || k, '', 0, 0 FROM change UNION
    SELECT dst, kind, CASE WHEN token = kind THEN rest - 1 ELSE CASE kind WHEN 'contains' THEN 1 ELSE 3 END - 1 END, depth + 1 FROM r JOIN e ON src = node WHERE depth < 5 AND (token <> kind OR rest > 0)) SELECT * FROM r)
    SELECT node, min(depth)::INT AS depth FROM w GROUP BY node""", "contains", "touches_supplier", "change")
def context_walk(spark, sf_dir, v):
    seeds = v("change").select(F.concat(F.lit("o"), "k").alias("node"))
    edge = lambda d, kind, a, b: d.select(F.lit(kind).alias("kind"), a.alias("src"), b.alias("dst"))
    contains = edge(v("contains"), "contains", F.concat(F.lit("o"), "container"), F.concat(F.lit("p"), "member"))
    return waves.reachable(seeds, contains.unionByName(edge(v("touches_supplier"), "calls", F.concat(F.lit("p"), "src"), F.concat(F.lit("s"), "dst"))), {"contains": 1, "calls": 3}, 5)


@query("""+w AS (WITH RECURSIVE r(id, spot) AS (SELECT id, "on" FROM ring UNION SELECT r.id, x."on" FROM r JOIN ring x ON x.id = r.spot) SELECT * FROM r)
    SELECT DISTINCT id FROM ring WHERE id NOT IN (SELECT id FROM w WHERE spot NOT IN (SELECT id FROM ring))""", "ring")
def cyclic_nodes(spark, sf_dir, v):
    return waves.levels(v("artifact").select(F.col("k").alias("id")), v("ring"))[1].select("id").distinct()


@query("""+w AS (WITH RECURSIVE r(node) AS (SELECT k FROM artifact WHERE end_line - start_line = 7 UNION SELECT CASE WHEN src = node THEN dst ELSE src END FROM r JOIN tree ON src = node OR dst = node) SELECT * FROM r)
    SELECT DISTINCT node FROM w""", "artifact", "tree")
def relevant_ids(spark, sf_dir, v):
    return graph.relevant(v("artifact").where("end_line - start_line = 7").select(F.col("k").alias("node")), v("tree"))


@query("""+w AS (WITH RECURSIVE r(node, ancestor, depth) AS (SELECT src, dst, 1 FROM tree UNION ALL SELECT node, dst, depth + 1 FROM r JOIN tree ON src = ancestor) SELECT * FROM r)
    SELECT node, ancestor, depth::INT AS depth FROM w""", "tree")
def containment_ancestors(spark, sf_dir, v):
    return graph.ancestors(v("tree").select(F.col("src").alias("node"), F.col("dst").alias("parent")))


_POLICY = [("node", "contains", "out", 1), ("node", "calls", "out", 2), ("contract", "calls", "both", 2), ("contract", "contains", "in", 1)]


@query("""+pol(rule, kind, way, most) AS (VALUES ('node', 'contains', 'out', 1), ('node', 'calls', 'out', 2), ('contract', 'calls', 'out', 2), ('contract', 'calls', 'in', 2), ('contract', 'contains', 'in', 1)),
    e AS (SELECT 'contains' AS kind, container AS src, 'p' || member AS dst FROM module_edge UNION ALL SELECT 'calls', 'p' || src, 's' || dst FROM touches_supplier),
    b AS (SELECT kind, 'out' AS way, src AS a, dst AS b FROM e UNION ALL SELECT kind, 'in', dst, src FROM e),
    w AS (WITH RECURSIVE r(rule, node, depth) AS (SELECT rule, 'p' || k, 0 FROM artifact, (SELECT DISTINCT rule FROM pol) WHERE own_change UNION
    SELECT r.rule, b.b, depth + 1 FROM r JOIN pol ON pol.rule = r.rule JOIN b ON b.kind = pol.kind AND b.way = pol.way AND b.a = r.node WHERE depth < most) SELECT * FROM r)
    SELECT rule, node, min(depth)::INT AS depth FROM w GROUP BY rule, node""", "artifact", "module_edge", "touches_supplier")
def impact_cone(spark, sf_dir, v):
    contains = v("module_edge").select(F.lit("contains").alias("kind"), F.col("container").alias("src"), F.concat(F.lit("p"), "member").alias("dst"))
    calls = v("touches_supplier").select(F.lit("calls").alias("kind"), F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("s"), "dst").alias("dst"))
    seeds = v("artifact").where("own_change").select(F.concat(F.lit("p"), "k").alias("node"))
    return graph.impact_cone(seeds, contains.unionByName(calls), spark.createDataFrame(_POLICY, "rule string, kind string, direction string, depth int"))


@query("""+c AS (SELECT k AS id, 'target_changed' AS reason FROM artifact WHERE own_change UNION ALL SELECT k, 'body_changed' FROM artifact WHERE k % 41 = 0),
    w AS (WITH RECURSIVE r(id) AS (SELECT id FROM c UNION SELECT src FROM r JOIN tree ON dst = id) SELECT * FROM r),
    a AS (SELECT id, reason, true AS direct FROM c UNION ALL SELECT DISTINCT src, 'dependency_changed', false FROM tree JOIN w ON dst = id)
    SELECT id, CASE WHEN bool_and(direct) THEN 'direct' WHEN bool_or(direct) THEN 'direct_and_indirect' ELSE 'indirect' END AS directness, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM a GROUP BY id""", "artifact", "tree")
def stale_obligations(spark, sf_dir, v):
    a = v("artifact")
    changed = a.where("own_change").select(F.col("k").alias("id"), F.lit("target_changed").alias("reason"))
    changed = changed.unionByName(a.where("k % 41 = 0").select(F.col("k").alias("id"), F.lit("body_changed").alias("reason")))
    return graph.staleness(changed, v("tree").select(F.col("src").alias("id"), F.col("dst").alias("on")))


@query("""+c AS (SELECT b.k AS source, a.k AS target FROM before_fn b JOIN after_fn a ON a.k = b.k OR a.k = b.k + 1 AND b.k % 29 = 0 OR a.k = b.k - 2 AND b.k % 31 = 0),
    n AS (SELECT 's' || k AS node, body, 1 AS s, 0 AS t FROM before_fn UNION ALL SELECT 't' || k, body, 0, 1 FROM after_fn), e AS (SELECT 's' || source AS a, 't' || target AS b FROM c UNION ALL SELECT 't' || target, 's' || source FROM c),
    w AS (WITH RECURSIVE r(node, spot) AS (SELECT node, node FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.spot) SELECT node, min(spot) AS component FROM r GROUP BY node),
    g AS (SELECT component, sum(s)::BIGINT AS sources, sum(t)::BIGINT AS targets, count(DISTINCT body) = 1 AS same FROM n JOIN w USING (node) GROUP BY component)
    SELECT component, sources, targets, CASE WHEN sources = 0 THEN 'added' WHEN targets = 0 THEN 'removed' WHEN sources = 1 AND targets = 1 THEN CASE WHEN same THEN 'preserved' ELSE 'modified' END
    WHEN sources = 1 THEN 'split' WHEN targets = 1 THEN 'merged' ELSE 'unresolved' END AS status FROM g""", "before_fn", "after_fn")
def candidate_components(spark, sf_dir, v):
    b, a = v("before_fn"), v("after_fn").select(F.col("k").alias("target"))
    shifted = b.select("k", F.explode(F.array_compact(F.array(F.col("k"), F.when(F.col("k") % 29 == 0, F.col("k") + 1), F.when(F.col("k") % 31 == 0, F.col("k") - 2)))).alias("target"))
    return graph.component_status(b, v("after_fn"), shifted.join(a, "target").select(F.col("k").alias("source"), "target"))


@query("SELECT status, coalesce(n, 0) AS n FROM (VALUES ('preserved'), ('modified'), ('added'), ('removed'), ('split'), ('merged'), ('unresolved')) x(status) LEFT JOIN (" +
       """SELECT CASE WHEN s IS NULL THEN 'added' WHEN t IS NULL THEN 'removed' WHEN s = 1 AND t = 1 THEN CASE WHEN x = y THEN 'preserved' ELSE 'modified' END WHEN s = 1 THEN 'split' WHEN t = 1 THEN 'merged' ELSE 'unresolved' END AS status, count(*) AS n
    FROM (SELECT anchor || body AS key, count(*) AS s, min(body) AS x FROM before_fn GROUP BY 1) FULL JOIN (SELECT anchor || body AS key, count(*) AS t, min(body) AS y FROM after_fn GROUP BY 1) USING (key) GROUP BY 1) USING (status)""", "before_fn", "after_fn")
def mapping_status_counts(spark, sf_dir, v):
    from .operators import diff, evidence

    keyed = lambda d: d.withColumn("key", F.concat("anchor", "body"))
    found = diff.component_status(keyed(v("before_fn")), keyed(v("after_fn")), "key", "body")
    return evidence.histogram(found, "status", ["preserved", "modified", "added", "removed", "split", "merged", "unresolved"])


@query("""+s AS (SELECT id FROM obligation WHERE status = 'P') SELECT id, (i - 1)::INT AS position, a[i] AS action, CASE WHEN i > 1 THEN a[i - 1] END AS after
    FROM s, (SELECT ['reproject', 'reviewer', 'verifier', 'human'] AS a), range(1, 5) r(i)""", "obligation")
def rerun_actions(spark, sf_dir, v):
    return graph.rerun_actions(v("obligation").where("status = 'P'"))


@query("""+f AS (SELECT k, start_line * 41 AS bytes, row_number() OVER (PARTITION BY path ORDER BY k) AS r, path LIKE '%test%' AS test, k % 3 = 0 AS reached FROM artifact)
    SELECT k, CASE WHEN r > 40 THEN 'path_cap' WHEN test AND r > 2 THEN 'test_cap' WHEN NOT reached THEN 'not_reached' WHEN r > 20 THEN 'included_file_cap' WHEN bytes > 1800 THEN 'artifact_bytes_cap' WHEN bytes % 7 = 0 THEN 'giant_line' END AS excluded_by FROM f""", "artifact")
def context_exclusions(spark, sf_dir, v):
    a = v("artifact")
    place = F.row_number().over(Window.partitionBy("path").orderBy("k"))
    rows = a.select("k", (F.col("start_line") * 41).alias("bytes"), place.alias("r"), F.col("path").contains("test").alias("test"), (F.col("k") % 3 == 0).alias("reached"))
    r, size = F.col("r"), F.col("bytes")
    flags = {"path_cap": r > 40, "test_cap": F.col("test") & (r > 2), "not_reached": ~F.col("reached"), "included_file_cap": r > 20, "artifact_bytes_cap": size > 1800, "giant_line": size % 7 == 0}
    return graph.exclusion(rows, flags).select("k", "excluded_by")
