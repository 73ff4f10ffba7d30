"""Queries of the mapping of two snapshots: suppliers are files, parts symbols, order lines relations between them, neighbours contexts, invariants and limitations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import snapshots
from .registry import query
from .store import discard, written

_VIEWS = ("vertex", "link_of", "rename_of")


def _stage(name: str, rows: str, before: str = "") -> str:
    """CTEs of one stage: groups of a key with vertices on both sides, and those vertices; before: stages that have consumed some of rows."""
    gone = f" WHERE (side, k) NOT IN ({before})" if before else ""
    return f""", r_{name} AS (SELECT * FROM ({rows}){gone}),
    g_{name} AS (SELECT key, count(*) FILTER (side = 'before') AS nb, count(*) FILTER (side = 'after') AS na, min(k) FILTER (side = 'before') AS kb, min(k) FILTER (side = 'after') AS ka, min(body) FILTER (side = 'before') IS NOT DISTINCT FROM min(body) FILTER (side = 'after') AS same
      FROM r_{name} WHERE key IS NOT NULL GROUP BY key HAVING count(*) FILTER (side = 'before') > 0 AND count(*) FILTER (side = 'after') > 0),
    m_{name} AS (SELECT side, k, '{name}' AS stage, nb, na, same, CASE WHEN nb = 1 AND na = 1 THEN CASE side WHEN 'before' THEN ka ELSE kb END END AS partner FROM r_{name} JOIN g_{name} USING (key))"""


def _neighbours(name: str, earlier: list[str], waits: list[str]) -> str:
    """CTEs of a stage whose keys are its members' pairs, as sorted text."""
    mapped = " UNION ALL ".join(f"SELECT * FROM m_{e}" for e in earlier)
    held = "".join(f" UNION ALL SELECT side, k, '', 2, 2, false, NULL FROM u_{w} WHERE blocked" for w in waits)
    rows = f"SELECT side, k, key, body FROM u_{name} WHERE NOT blocked"
    return f""", a_{name} AS ({mapped}{held}),
    n_{name} AS (SELECT side, k AS member, CASE side WHEN 'before' THEN k ELSE partner END AS name, CASE WHEN partner IS NULL THEN true END AS stuck FROM a_{name}),
    t_{name} AS (SELECT l.side, l.k, count(*) FILTER (n.name IS NULL OR stuck) AS open, count(*) FILTER (stuck) AS unresolved, string_agg(place || ':' || n.name, ',' ORDER BY place, n.name) AS told FROM link_of l LEFT JOIN n_{name} n USING (side, member) GROUP BY 1, 2),
    u_{name} AS (SELECT side, k, CASE WHEN open = 0 THEN coalesce(label, '') || '|' || told END AS key, body, coalesce(unresolved, 1) > 0 AS blocked FROM vertex LEFT JOIN t_{name} USING (side, k) WHERE kind = '{name}')""" + _stage(name, rows)


_FIRST = ["path", "rename", "symbol_label", "symbol_anchor", "exact_key"]
_MAPPED = (
    "+one AS (SELECT 1)"
    + _stage("path", "SELECT side, k, path AS key, body FROM vertex WHERE kind = 'file'")
    + _stage("rename", "SELECT side, k, CASE side WHEN 'before' THEN x.new ELSE v.path END || chr(31) || body AS key, body FROM vertex v LEFT JOIN (SELECT old, min(new) AS new FROM rename_of GROUP BY 1) x ON x.old = v.path WHERE kind = 'file'", "SELECT side, k FROM m_path")
    + _stage("symbol_label", "SELECT side, k, path || chr(31) || label AS key, body FROM vertex WHERE kind = 'symbol'")
    + _stage("symbol_anchor", "SELECT side, k, anchor AS key, body FROM vertex WHERE kind = 'symbol'", "SELECT side, k FROM m_symbol_label")
    + _stage("exact_key", "SELECT side, k, kind || chr(31) || path || chr(31) || label AS key, body FROM vertex WHERE kind NOT IN ('file', 'symbol', 'relation', 'context', 'invariant', 'limitation')")
    + _neighbours("relation", _FIRST, [])
    + _neighbours("context", [*_FIRST, "relation"], ["relation"])
    + _neighbours("invariant", [*_FIRST, "relation", "context"], ["relation", "context"])
    + _neighbours("limitation", [*_FIRST, "relation", "context", "invariant"], ["relation", "context", "invariant"])
    + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM m_{s}" for s in [*_FIRST, "relation", "context", "invariant", "limitation"]) + ")"
    + ", waits AS (" + " UNION ALL ".join(f"SELECT side, k FROM u_{s} WHERE blocked" for s in ("relation", "context", "invariant", "limitation")) + ")"
    + """, mapping AS (SELECT side, k, kind, coalesce(stage, 'none') AS stage, CASE WHEN nb = 1 AND na = 1 THEN CASE WHEN same THEN 'preserved' ELSE 'modified' END WHEN nb = 1 THEN 'split' WHEN na = 1 THEN 'merged' WHEN nb > 1 THEN 'unresolved'
      WHEN (side, k) IN (SELECT side, k FROM waits) THEN 'unresolved' WHEN side = 'before' THEN 'removed' ELSE 'added' END AS status, partner FROM vertex LEFT JOIN every USING (side, k))"""
)


def _touches(pairs):
    """The relations of vertex and link_of, each with its ends: before and after of every pair of a part and a supplier. On the after side some point the other way."""
    text = lambda a, *b: F.concat(F.lit(a), *b)
    back = F.expr("(src + dst) % 23 = 0")
    k, symbol, file = [text("relation:", "src", F.lit("-"), "dst"), text("r2:", "src", F.lit("-"), "dst")], [text("symbol:", "src"), text("s2:", "src")], [text("file:", "dst"), text("f2:", "dst")]
    body = [F.expr("concat('w', src % 3)"), F.expr("concat('w', CASE WHEN dst % 8 = 0 THEN 0 ELSE src % 3 END)")]
    ends = [(symbol[0], file[0]), (F.when(back, file[1]).otherwise(symbol[1]), F.when(back, symbol[1]).otherwise(file[1]))]
    sides = [pairs.select(F.lit(side).alias("side"), k[i].alias("k"), F.lit("touches").alias("label"), body[i].alias("body"), ends[i][0].alias("source"), ends[i][1].alias("target")) for i, side in enumerate(("before", "after"))]
    every = sides[0].unionByName(sides[1])
    nameless = every.where("k IS NULL").withColumns({c: F.lit(None).cast("string") for c in ("source", "target")}).distinct()  # rows without a key are alike
    return every.where("k IS NOT NULL").unionByName(nameless)


def _mapped(v):
    pairs = written(v("touches_supplier"), "pairs")
    links = v("link_of").where("NOT (k LIKE 'relation:%' OR k LIKE 'r2:%')")
    mapped = snapshots.map_snapshots(v("vertex").where("kind <> 'relation'"), links, v("rename_of"), _touches(pairs))
    discard(pairs)
    return mapped


@query(_MAPPED + " SELECT side, k, kind, stage, status, partner FROM mapping", *_VIEWS)
def neighbour_mapping(spark, sf_dir, v):
    return _mapped(v)


@query(_MAPPED + " SELECT kind, stage, status, side, count(*) AS n FROM mapping GROUP BY ALL", *_VIEWS)
def neighbour_mapping_counts(spark, sf_dir, v):
    return _mapped(v).groupBy("kind", "stage", "status", "side").agg(F.count(F.lit(1)).alias("n"))
