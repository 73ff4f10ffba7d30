"""Queries of documents judged by the schemas they name: an order is a finding, a run report or a note, with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import schemas
from .registry import query

SCHEMAS = {
    "finding.v1": {
        "type": "object", "required": ["id", "severity", "lines"], "additionalProperties": False,
        "properties": {"id": {"type": "string", "pattern": "^finding:[0-9]+$"}, "severity": {"enum": ["low", "high"]}, "lines": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "integer", "minimum": 1}}, "extra": {"type": "boolean"}},
    },
    "run.v2": {
        "type": "object", "required": ["schema", "counts"],
        "properties": {"schema": {"const": "run.v2"}, "counts": {"type": "object", "required": ["admitted", "deferred"], "properties": {"admitted": {"type": "integer", "minimum": 0, "maximum": 900}, "deferred": {"type": "integer"}}}},
    },
    "note.v1": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 12}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string"}}}},
}

_VIOLATED = """+k AS (SELECT o_orderkey AS k FROM orders),
    f AS (SELECT k, CASE WHEN k % 27 = 0 THEN []::BIGINT[] WHEN k % 51 = 0 THEN [3, 0, 3] ELSE [k, k + 1] END AS lines FROM k WHERE k % 4 = 0),
    bad AS (SELECT k, 'finding.v1' AS schema, '/id' AS pointer, 'pattern' AS rule FROM f WHERE k % 21 = 0 UNION ALL SELECT k, 'finding.v1', '/severity', 'enum' FROM f WHERE k % 33 = 0 UNION ALL SELECT k, 'finding.v1', '/lines', 'required' FROM f WHERE k % 39 = 0
      UNION ALL SELECT k, 'finding.v1', '/lines', 'minItems' FROM f WHERE k % 39 <> 0 AND len(lines) = 0 UNION ALL SELECT k, 'finding.v1', '/lines', 'uniqueItems' FROM f WHERE k % 39 <> 0 AND len(list_distinct(lines)) < len(lines)
      UNION ALL SELECT k, 'finding.v1', '/lines/' || (i - 1), 'minimum' FROM f, unnest(range(1, len(lines) + 1)) u(i) WHERE k % 39 <> 0 AND lines[i] < 1 UNION ALL SELECT k, 'finding.v1', '/more', 'additionalProperties' FROM f WHERE k % 57 = 0
      UNION ALL SELECT k, 'run.v2', '', 'malformed' FROM k WHERE k % 4 = 1 AND k % 29 = 0 UNION ALL SELECT k, 'run.v2', '/schema', 'const' FROM k WHERE k % 4 = 1 AND k % 29 <> 0 AND k % 31 = 0
      UNION ALL SELECT k, 'run.v2', '/counts', 'type' FROM k WHERE k % 4 = 1 AND k % 29 <> 0 AND k % 37 = 0 UNION ALL SELECT k, 'run.v2', '/counts/admitted', CASE WHEN k % 41 = 0 THEN 'type' WHEN k % 1000 > 900 THEN 'maximum' ELSE 'minimum' END FROM k
        WHERE k % 4 = 1 AND k % 29 <> 0 AND k % 37 <> 0 AND (k % 41 = 0 OR k % 1000 > 900 OR k % 1000 < 5) UNION ALL SELECT k, 'run.v2', '/counts/deferred', 'required' FROM k WHERE k % 4 = 1 AND k % 29 <> 0 AND k % 37 <> 0 AND k % 43 = 0
      UNION ALL SELECT k, 'note.v1', '/text', CASE WHEN k % 47 = 0 THEN 'minLength' ELSE 'maxLength' END FROM k WHERE k % 4 = 2 AND (k % 47 = 0 OR k % 53 = 0) UNION ALL SELECT k, 'note.v1', '/tags', 'maxItems' FROM k WHERE k % 4 = 2 AND k % 23 = 0
      UNION ALL SELECT k, 'note.v1', '/tags/1', 'type' FROM k WHERE k % 4 = 2 AND k % 19 = 0 UNION ALL SELECT k, 'none.v9', '', 'unknown_schema' FROM k WHERE k % 4 = 3)"""

_SCHEMA = "CASE k % 4 WHEN 0 THEN 'finding.v1' WHEN 1 THEN 'run.v2' WHEN 2 THEN 'note.v1' ELSE 'none.v9' END"
_BODY = """CASE k % 4 WHEN 0 THEN concat('{"id":"', IF(k % 21 = 0, 'bad', concat('finding:', k)), '","severity":"', IF(k % 33 = 0, 'odd', 'low'), '"',
      IF(k % 39 = 0, '', concat(',"lines":[', CASE WHEN k % 27 = 0 THEN '' WHEN k % 51 = 0 THEN '3,0,3' ELSE concat(k, ',', k + 1) END, ']')), IF(k % 57 = 0, ',"more":1', ''), '}')
    WHEN 1 THEN concat('{"schema":"', IF(k % 31 = 0, 'run.v1', 'run.v2'), '","counts":', IF(k % 37 = 0, '[1]', concat('{"admitted":', IF(k % 41 = 0, '"7"', CAST(k % 1000 - 5 + IF(k % 1000 > 900, 5, 0) AS STRING)), IF(k % 43 = 0, '', ',"deferred":null'), '}')), IF(k % 29 = 0, '', '}'))
    ELSE concat('{"text":"', IF(k % 47 = 0, '', IF(k % 53 = 0, 'a text that is too long', 'short')), '","tags":["a"', IF(k % 19 = 0, ',5', ',"b"'), IF(k % 23 = 0, ',"c"', ''), ']}') END"""


def _documents(v):
    rows = v("obligation").select("k")
    return rows.select(F.col("k").alias("id"), F.expr(_SCHEMA).alias("schema"), F.regexp_replace(F.expr(_BODY), '"deferred":null', '"deferred":3').alias("body"))


@query(_VIOLATED.replace("+k AS", "WITH k AS") + " SELECT k AS id, schema, pointer, rule FROM bad")
def schema_violations(spark, sf_dir, v):
    return schemas.violations(_documents(v), SCHEMAS)


@query(_VIOLATED.replace("+k AS", "WITH k AS") + " SELECT schema, rule, count(*) AS violations, count(DISTINCT k) AS documents FROM bad GROUP BY 1, 2")
def schema_violation_counts(spark, sf_dir, v):
    return schemas.violations(_documents(v), SCHEMAS).groupBy("schema", "rule").agg(F.count(F.lit(1)).alias("violations"), F.countDistinct("id").alias("documents"))
