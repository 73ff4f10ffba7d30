"""Queries of bounded contexts and bounded reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import contexts, folds
from .registry import query, table

_BUDGETS = {"calls": 3, "callers": 2, "covers": 1}
_CAPS = {"path_cap": 24, "test_cap": 2, "included_file_cap": 6, "artifact_bytes_cap": 9000, "total_resolved_bytes_cap": 60000, "excerpt_bytes_cap": 1600, "total_excerpt_bytes_cap": 6000}

_WALK = """+e AS (SELECT 'calls' AS kind, concat('p', src) AS src, concat('p', dst) AS dst FROM tree UNION SELECT 'callers', concat('p', dst), concat('p', src) FROM tree UNION SELECT 'covers', concat('p', id), concat('p', "on") FROM ring),
    seed AS (SELECT DISTINCT container AS context, concat('p', member) AS node FROM contains WHERE container IN (SELECT k FROM change)),
    w AS (WITH RECURSIVE r AS (SELECT context, node, '' AS token, 0 AS rest, 0 AS depth, [node] AS path FROM seed
      UNION SELECT context, dst, kind, CASE WHEN token = kind THEN rest ELSE CASE kind WHEN 'calls' THEN 3 WHEN 'callers' THEN 2 ELSE 1 END END - 1, depth + 1, list_append(path, dst)
      FROM r JOIN e ON src = node WHERE depth < 5 AND (token <> kind OR rest > 0)) SELECT * FROM r),
    reached AS (SELECT context, node, (min({'d': depth, 'p': path})).d AS depth, (min({'d': depth, 'p': path})).p AS path FROM w GROUP BY 1, 2)"""

_CHOSEN = _WALK + """, best AS (SELECT context, file, min({'d': depth, 'p': path}) AS p FROM reached JOIN cfile_holds USING (node) GROUP BY 1, 2),
    ranked AS (SELECT context, file, p.d AS depth, p.p AS path, bytes, excerpt, is_test, giant, row_number() OVER (PARTITION BY context ORDER BY p, file) AS place,
      count(*) FILTER (is_test) OVER (PARTITION BY context ORDER BY p, file ROWS UNBOUNDED PRECEDING) AS tests FROM best JOIN cfile USING (file)),
    f AS (WITH RECURSIVE r AS (SELECT context, 0::BIGINT AS place, 0::BIGINT AS resolved, 0::BIGINT AS shown, 0 AS included, '' AS reason FROM (SELECT DISTINCT context FROM ranked)
      UNION ALL SELECT context, place, CASE WHEN reason IN ('', 'giant_line', 'excerpt_bytes_cap', 'total_excerpt_bytes_cap') THEN resolved + bytes ELSE resolved END, CASE WHEN reason = '' THEN shown + excerpt ELSE shown END,
        CASE WHEN reason = '' THEN included + 1 ELSE included END, reason FROM (SELECT r.context, x.place, resolved, shown, included, bytes, excerpt, CASE WHEN x.place > 24 THEN 'path_cap' WHEN is_test AND tests > 2 THEN 'test_cap' WHEN included >= 6 THEN 'included_file_cap'
        WHEN bytes > 9000 THEN 'artifact_bytes_cap' WHEN resolved + bytes > 60000 THEN 'total_resolved_bytes_cap' WHEN giant THEN 'giant_line' WHEN excerpt > 1600 THEN 'excerpt_bytes_cap' WHEN shown + excerpt > 6000 THEN 'total_excerpt_bytes_cap' ELSE '' END AS reason
        FROM r JOIN ranked x ON x.context = r.context AND x.place = r.place + 1) q) SELECT * FROM r WHERE place > 0),
    chosen AS (SELECT ranked.context, file, ranked.place, depth, path, bytes, excerpt, nullif(reason, '') AS reason FROM ranked JOIN f ON f.context = ranked.context AND f.place = ranked.place)"""


def _seeds(v):
    part = lambda c: F.concat(F.lit("p"), F.col(c))
    edge = lambda d, kind, a, b: d.select(F.lit(kind).alias("kind"), part(a).alias("src"), part(b).alias("dst"))
    edges = edge(v("tree"), "calls", "src", "dst").unionByName(edge(v("tree"), "callers", "dst", "src")).unionByName(edge(v("ring"), "covers", "id", "on"))
    seeds = v("contains").join(v("change").select(F.col("k").alias("container")), "container", "left_semi").select(F.col("container").alias("context"), part("member").alias("node"))
    return seeds, edges


def _files(v, seeds, edges, **kind):
    return contexts.files_in_rounds(seeds, edges, v("cfile_holds"), v("cfile"), _BUDGETS, _CAPS, 5, **kind)


@query(_WALK + " SELECT context, node, depth, array_to_string(path, '>') AS path FROM reached", "tree", "ring", "contains", "change")
def context_paths(spark, sf_dir, v):
    return contexts.canonical_paths(*_seeds(v), _BUDGETS, 5).select("context", "node", "depth", F.array_join("path", ">").alias("path"))


@query(_CHOSEN + " SELECT context, file, place, depth, array_to_string(path, '>') AS path, bytes, excerpt, reason FROM chosen", "tree", "ring", "contains", "change", "cfile", "cfile_holds")
def context_files(spark, sf_dir, v):
    return _files(v, *_seeds(v)).withColumn("path", F.array_join("path", ">"))


@query(_CHOSEN + """ SELECT context, coalesce(reason, 'included') AS reason, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM chosen GROUP BY 1, 2
    UNION ALL SELECT s.context, 'not_reached', (SELECT count(*) FROM cfile) - coalesce(n, 0), NULL FROM (SELECT DISTINCT context FROM seed) s LEFT JOIN (SELECT context, count(*) AS n FROM chosen GROUP BY 1) c USING (context) WHERE (SELECT count(*) FROM cfile) > coalesce(n, 0)""", "tree", "ring", "contains", "change", "cfile", "cfile_holds")
def context_file_exclusions(spark, sf_dir, v):
    seeds, edges = _seeds(v)
    return contexts.excluded(_files(v, seeds, edges, counted=True), seeds, v("cfile").count())


@query("""WITH RECURSIVE p AS (SELECT o_custkey % 3 AS snapshot, o_orderkey AS path, floor(o_totalprice)::BIGINT % 700 AS size, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS n FROM orders),
    r AS (SELECT DISTINCT snapshot, 0::BIGINT AS n, 0::BIGINT AS total, '' AS outcome FROM p
      UNION ALL SELECT snapshot, n, CASE WHEN outcome = 'accepted' THEN total + size ELSE total END, outcome FROM (SELECT r.snapshot, p.n, total, size, CASE WHEN p.n > 4000 THEN 'too_many_files' WHEN size > 650 THEN 'file_too_large' WHEN total + size > 500000 THEN 'total_exceeded' ELSE 'accepted' END AS outcome
      FROM r JOIN p ON p.snapshot = r.snapshot AND p.n = r.n + 1) q)
    SELECT snapshot, path, size, outcome FROM r JOIN p USING (snapshot, n)""")
def bounded_snapshot_read(spark, sf_dir, v):
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("snapshot"), F.col("o_orderkey").alias("path"), F.expr("CAST(floor(o_totalprice) AS BIGINT) % 700").alias("size"))
    return folds.bounded(files, "snapshot", "path", "size", 650, 500_000, 4000)
