"""JSON schemas compiled to columns: every violation of a document is a row with a pointer to its place."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<struct<pointer:string,rule:string>>"
#: How JSON types are named where a value's own type is told.
TYPES = {"object": ["OBJECT<"], "array": ["ARRAY<"], "string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "boolean": ["BOOLEAN"], "null": ["VOID"]}


def _said(bad: Column, pointer: Column, rule: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(pointer.alias("pointer"), F.lit(rule).alias("rule")))).otherwise(F.array().cast(_NONE))


def _is(value: Column, kind: str) -> Column:
    told = F.schema_of_variant(value)
    return F.array_contains(F.array(*[told.startswith(t) for t in TYPES[kind]]), True)


def _member(value: Column, key: str) -> Column:
    return F.variant_get(value, "$[" + json.dumps(key) + "]", "variant")


def compiled(value: Column, schema: dict, pointer: Column) -> Column:
    """The violations of a variant under a schema, as an array of (pointer, rule); a value of the wrong type has that violation alone.

    Known are type, enum, const, required, properties, additionalProperties (false), minimum, maximum, minLength, maxLength, pattern, minItems,
    maxItems, uniqueItems and items. Another rule raises ValueError.
    """
    known = {"type", "enum", "const", "required", "properties", "additionalProperties", "minimum", "maximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "items"}
    if set(schema) - known:
        raise ValueError(f"schema rules that aren't known: {sorted(set(schema) - known)}")
    found = []
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    same = lambda x: F.to_json(value) == F.lit(json.dumps(x, separators=(",", ":"), ensure_ascii=False))
    if "const" in schema:
        found.append(_said(~same(schema["const"]), pointer, "const"))
    if "enum" in schema:
        hit = F.lit(False)
        for x in schema["enum"]:
            hit = hit | same(x)
        found.append(_said(~hit, pointer, "enum"))
    if _is_type := schema.get("type"):
        if _is_type == "string":
            found += [_said(bad, pointer, r) for r, bad in (("minLength", F.length(text) < schema.get("minLength", 0)), ("maxLength", F.length(text) > schema.get("maxLength", 1 << 30))) if r in schema]
            if "pattern" in schema:
                found.append(_said(~text.rlike(schema["pattern"]), pointer, "pattern"))
        if _is_type in ("integer", "number"):
            found += [_said(bad, pointer, r) for r, bad in (("minimum", number < schema.get("minimum", 0)), ("maximum", number > schema.get("maximum", 0))) if r in schema]
        if _is_type == "array":
            items = F.try_variant_get(value, "$", "array<variant>")
            found += [_said(bad, pointer, r) for r, bad in (("minItems", F.size(items) < schema.get("minItems", 0)), ("maxItems", F.size(items) > schema.get("maxItems", 0))) if r in schema]
            if schema.get("uniqueItems"):
                found.append(_said(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), pointer, "uniqueItems"))
            if "items" in schema:
                found.append(F.flatten(F.transform(items, lambda x, i: compiled(x, schema["items"], F.concat(pointer, F.lit("/"), i.cast("string"))))))
        if _is_type == "object":
            below = lambda k: F.concat(pointer, F.lit("/" + k.replace("~", "~0").replace("/", "~1")))
            found += [_said(_member(value, k).isNull(), below(k), "required") for k in schema.get("required", [])]
            if schema.get("additionalProperties") is False:
                others = F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))
                found.append(F.transform(others, lambda k: F.struct(F.concat(pointer, F.lit("/"), k).alias("pointer"), F.lit("additionalProperties").alias("rule"))))
            for k, inner in schema.get("properties", {}).items():
                member = _member(value, k)
                found.append(F.when(member.isNull(), F.array().cast(_NONE)).otherwise(compiled(member, inner, below(k))))
    every = F.coalesce(F.concat(*found), F.array().cast(_NONE)) if found else F.array().cast(_NONE)
    return F.when(_is(value, schema["type"]), every).otherwise(_said(F.lit(True), pointer, "type")) if "type" in schema else every


def violations(documents: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(id, schema, pointer, rule) of documents(id, schema, body: JSON text), each judged by the schema it names; valid ones have no row.

    A name that isn't known is unknown_schema, a null or malformed body malformed, both at the root.
    """
    body = F.try_parse_json("body")
    root = F.lit("")
    found = _said(F.lit(True), root, "unknown_schema")
    for name, schema in sorted(schemas.items()):
        judged = F.when(body.isNull(), _said(F.lit(True), root, "malformed")).otherwise(compiled(F.col("_v"), schema, root))
        found = F.when(F.col("schema") == name, judged).otherwise(found)
    return documents.select("id", "schema", "body", body.alias("_v")).select("id", "schema", F.explode(found).alias("f")).select("id", "schema", "f.pointer", "f.rule")
