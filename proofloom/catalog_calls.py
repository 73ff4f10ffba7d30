"""Queries of call resolution over scope trees, imports and re-exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import calls
from .registry import query

_SITES = ("csite", "decl", "shadow", "import_of", "glob_of", "alias_of", "reexport")
_VIEWS = ("decl", "shadow", "csite", "import_of", "glob_of", "alias_of", "reexport")

#: ends: what each imported name of a known module comes to, through at most 8 re-exports; a way ends where the file declares the name.
_EXPORTS = """+pub AS (SELECT k, file, name FROM decl WHERE owner IS NULL AND public), al AS (SELECT file, exported, min(name) AS inner_name FROM alias_of GROUP BY 1, 2),
    bound AS (SELECT file, local AS name, min({'p': place, 'm': module, 'i': imported}) AS b FROM import_of GROUP BY 1, 2), mods AS (SELECT file AS module FROM decl UNION SELECT file FROM reexport),
    w AS (WITH RECURSIVE r AS (
      SELECT q.f AS of_file, q.n AS of_name, q.f AS file, coalesce(inner_name, q.n) AS name, 0 AS depth FROM (SELECT DISTINCT b.m AS f, b.i AS n FROM bound WHERE b.m IN (SELECT module FROM mods)) q LEFT JOIN al ON al.file = q.f AND exported = q.n
      UNION SELECT of_file, of_name, x.module, coalesce(inner_name, CASE x.exported WHEN '*' THEN r.name ELSE x.imported END), depth + 1 FROM r JOIN reexport x ON x.file = r.file AND x.exported IN ('*', r.name)
      LEFT JOIN al ON al.file = x.module AND al.exported = CASE x.exported WHEN '*' THEN r.name ELSE x.imported END WHERE depth < 8 AND (r.file, r.name) NOT IN (SELECT file, name FROM pub)) SELECT DISTINCT of_file, of_name, file, name FROM r),
    ends AS (SELECT of_file, of_name, count(DISTINCT k) AS n, min(k) AS k FROM w JOIN pub USING (file, name) GROUP BY 1, 2)"""

_CALLS = _EXPORTS + """, free AS (SELECT file, scope, name, count(*) AS n, min(k) AS k FROM decl WHERE owner IS NULL GROUP BY 1, 2, 3),
    scopes AS (SELECT c.file, c.scope AS from_scope, c.name, arg_max({'n': f.n, 'k': f.k, 'same': f.scope = c.scope}, length(f.scope)) AS s FROM (SELECT DISTINCT file, scope, name FROM csite) c
      JOIN free f ON f.file = c.file AND f.name = c.name AND (f.scope = '' OR f.scope = c.scope OR starts_with(c.scope, f.scope || '.')) GROUP BY ALL),
    globs AS (SELECT g.file, name, min({'p': place, 'n': n, 'k': k}) AS g FROM glob_of g JOIN (SELECT file AS module, name, count(*) AS n, min(k) AS k FROM decl WHERE owner IS NULL AND public AND scope = '' GROUP BY 1, 2) USING (module) GROUP BY 1, 2),
    names AS (SELECT name, count(*) AS n, min(k) AS k FROM decl WHERE owner IS NULL GROUP BY 1), pubs AS (SELECT name, count(*) AS n, min(k) AS k FROM pub GROUP BY 1),
    m1 AS (SELECT owner, file, name, count(*) AS n, min(k) AS k FROM decl WHERE owner IS NOT NULL GROUP BY 1, 2, 3), m2 AS (SELECT owner, name, count(*) AS n, min(k) AS k FROM decl WHERE owner IS NOT NULL GROUP BY 1, 2),
    m3 AS (SELECT name, count(*) AS n, min(k) AS k FROM decl WHERE owner IS NOT NULL GROUP BY 1),
    pick AS (SELECT c.call_id, c.caller, CASE WHEN form = 'self' THEN CASE WHEN m1.n IS NOT NULL THEN {'t': 'self_receiver', 'n': m1.n, 'k': m1.k, 'e': true} WHEN m2.n IS NOT NULL THEN {'t': 'self_receiver', 'n': m2.n, 'k': m2.k, 'e': false}
        WHEN m3.n IS NOT NULL THEN {'t': 'name', 'n': m3.n, 'k': m3.k, 'e': false} ELSE {'t': 'none', 'n': 0, 'k': NULL, 'e': false} END
      WHEN (c.caller, c.name) IN (SELECT caller, name FROM shadow) THEN {'t': 'local_shadow', 'n': 0, 'k': NULL, 'e': false}
      WHEN b.b IS NOT NULL AND b.b.m IN (SELECT module FROM mods) THEN {'t': 'import', 'n': coalesce(ends.n, 0), 'k': ends.k, 'e': true} WHEN b.b IS NOT NULL THEN {'t': 'import', 'n': coalesce(pubs.n, 0), 'k': pubs.k, 'e': false}
      WHEN s.s IS NOT NULL THEN {'t': CASE WHEN s.s.same THEN 'same_scope' ELSE 'enclosing_scope' END, 'n': s.s.n, 'k': s.s.k, 'e': true} WHEN g.g IS NOT NULL THEN {'t': 'glob_import', 'n': g.g.n, 'k': g.g.k, 'e': true}
      WHEN names.n IS NOT NULL THEN {'t': 'name', 'n': names.n, 'k': names.k, 'e': false} ELSE {'t': 'none', 'n': 0, 'k': NULL, 'e': false} END AS r
      FROM csite c LEFT JOIN bound b ON b.file = c.file AND b.name = c.name LEFT JOIN ends ON of_file = b.b.m AND of_name = b.b.i LEFT JOIN pubs ON pubs.name = b.b.i
      LEFT JOIN scopes s ON s.file = c.file AND s.from_scope = c.scope AND s.name = c.name LEFT JOIN globs g ON g.file = c.file AND g.name = c.name LEFT JOIN names ON names.name = c.name
      LEFT JOIN m1 ON m1.owner = c.owner AND m1.file = c.file AND m1.name = c.name LEFT JOIN m2 ON m2.owner = c.owner AND m2.name = c.name LEFT JOIN m3 ON m3.name = c.name),
    resolved AS (SELECT call_id, caller, r.t AS tier, r.n::BIGINT AS candidates, CASE WHEN r.n = 1 THEN r.k END AS target, CASE WHEN r.n = 0 THEN 'unresolved' WHEN r.n > 1 THEN 'ambiguous' WHEN r.e THEN 'exact' ELSE 'name_only' END AS confidence FROM pick)"""


def _resolved(v):
    return calls.resolve(*[v(n) for n in _SITES])


@query(_CALLS + " SELECT call_id, tier, candidates, target, confidence FROM resolved", *_VIEWS)
def tiered_calls(spark, sf_dir, v):
    return _resolved(v)


@query(_CALLS + " SELECT tier, confidence, count(*) AS calls, count(DISTINCT target) AS targets FROM resolved GROUP BY 1, 2", *_VIEWS)
def tiers_by_confidence(spark, sf_dir, v):
    return _resolved(v).groupBy("tier", "confidence").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("target").alias("targets"))


@query(_CALLS + " SELECT caller, target, CASE WHEN bool_or(confidence = 'exact') THEN 'exact' ELSE 'name_only' END AS confidence, count(*) AS calls FROM resolved WHERE target IS NOT NULL GROUP BY 1, 2", *_VIEWS)
def tiered_call_edges(spark, sf_dir, v):
    return calls.edges(calls.resolved(*[v(n) for n in _SITES]))


@query(_EXPORTS + " SELECT of_file AS file, of_name AS name, n, k FROM ends", *_VIEWS)
def followed_exports(spark, sf_dir, v):
    wanted = v("import_of").groupBy("file", "local").agg(F.min(F.struct("place", "module", "imported")).alias("i")).select(F.col("i.module").alias("file"), F.col("i.imported").alias("name"))
    public = v("decl").where("owner IS NULL AND public").select("k", "file", "name")
    return calls.exported(wanted, public, v("alias_of"), v("reexport"))
