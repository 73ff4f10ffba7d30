"""Stores, journals and typed readers: JSON facts in, content-addressed objects, indexes, manifests and Markdown out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import fresh_path, written


def strict(rows: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """(key, status, value) of JSON text read by a schema: accepted, not_json, or field_missing for a null field at the top.

    value is null unless accepted. Duplicate keys inside an object are not looked for.
    """
    t = F.trim(text)
    value = F.from_json(t, schema)
    names = rows.sparkSession.createDataFrame([], schema).columns
    whole = F.when(F.coalesce(t, F.lit("")) == "", "not_json").when(F.get_json_object(t, "$").isNull(), "not_json")
    gap = None
    for n in names:
        gap = value[n].isNull() if gap is None else gap | value[n].isNull()
    status = whole.when(gap, "field_missing").otherwise("accepted")
    return rows.select(key, status.alias("status"), F.when(status == "accepted", value).alias("value"))


def journal(lines: DataFrame, stream: str, number: str, text: str, schema: str = "seq long, hash string, prev string") -> DataFrame:
    """(stream, number, status) of JSONL lines: ok, chain_broken, corrupt, or torn_tail for an unreadable last line of a stream."""
    w = Window.partitionBy(stream).orderBy(number)
    e = F.from_json(text, schema)
    rows = lines.select(stream, number, F.when(F.get_json_object(text, "$").isNotNull() & e["seq"].isNotNull(), e).alias("e"))
    rows = rows.withColumns({"_last": F.lead(number).over(w).isNull(), "_hash": F.lag("e.hash").over(w)})
    broken = F.col("_hash").isNotNull() & ~F.col("e.prev").eqNullSafe(F.col("_hash"))
    status = F.when(F.col("e").isNull(), F.when(F.col("_last"), "torn_tail").otherwise("corrupt")).when(broken, "chain_broken").otherwise("ok")
    return rows.select(stream, number, status.alias("status"))


def put_objects(rows: DataFrame, content: str) -> DataFrame:
    """Writes each distinct content once under its sha256, in files by its first two digits; returns (sha256, content) as read back."""
    named = rows.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    path = fresh_path(rows.sparkSession, "objects")
    named.withColumn("shard", F.substring("sha256", 1, 2)).repartition("shard").write.partitionBy("shard").parquet(path)
    return rows.sparkSession.read.parquet(path).select("sha256", "content")


def verified_objects(objects: DataFrame) -> DataFrame:
    """(sha256, bytes, intact): whether the content still has the digest it is kept under."""
    return objects.select("sha256", F.octet_length("content").cast("long").alias("bytes"), (F.sha2("content", 256) == F.col("sha256")).alias("intact"))


def rebuild_index(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table of the index written anew and read back; a rebuild from the same log gives the same rows."""
    return {name: written(df, f"index-{name}") for name, df in tables.items()}


def manifest(artifacts: DataFrame, name: str, content: str) -> DataFrame:
    """(name, bytes, sha256) of each artifact of a directory sink."""
    return artifacts.select(F.col(name).alias("name"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(F.col(content), 256).alias("sha256"))


def markdown(rows: DataFrame, by: str, title: Column, line: Column, order: Column) -> DataFrame:
    """(by, markdown): a section per group with a bullet a row, in order; groups are meant to be report-sized."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))), lambda x: F.concat(F.lit("- "), x["t"]))
    return rows.groupBy(by).agg(F.concat(F.lit("## "), F.first(title), F.lit("\n\n"), F.array_join(items, "\n")).alias("markdown"))


def registry(schemas: dict[str, str], spark: SparkSession) -> DataFrame:
    """(schema, position, field, type) of every registered schema."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, s in sorted(schemas.items()) for i, f in enumerate(spark.createDataFrame([], s).schema)]
    return spark.createDataFrame(rows, "schema string, position int, field string, type string")


def migrate(rows: DataFrame, key: str, renamed: dict[str, str], added: dict[str, Column], dropped: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the next version, losses(key, field, value)): fields that are dropped with a value are losses, one row each."""
    keep = [c for c in rows.columns if c not in dropped]
    after = rows.select(*[F.col(c).alias(renamed.get(c, c)) for c in keep], *[v.alias(n) for n, v in added.items()])
    lost = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in dropped])
    return after, rows.select(key, F.explode(lost).alias("l")).where("l.value IS NOT NULL").select(key, "l.field", "l.value")


def packages(raw: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(packages(name, manifest, directory), edges(package, needs, path)) of build metadata in JSON, one document a row."""
    schema = "packages array<struct<name:string,manifest_path:string,dependencies:array<struct<name:string,path:string>>>>"
    found = raw.select(F.explode(F.from_json(text, schema)["packages"]).alias("p"))
    known = found.select(F.col("p.name").alias("name"), F.col("p.manifest_path").alias("manifest"), F.regexp_replace("p.manifest_path", "/[^/]*$", "").alias("directory"))
    edges = found.select(F.col("p.name").alias("package"), F.explode("p.dependencies").alias("d")).select("package", F.col("d.name").alias("needs"), F.col("d.path").alias("path"))
    return known, edges


def inventory(files: DataFrame, regular: Column, excluded: Column, unread: Column, failed: Column) -> DataFrame:
    """files with outcome: unsupported_entry, profile_excluded, unread_bound, parse_failed or parsed, in this order."""
    return files.withColumn("outcome", F.when(~regular, "unsupported_entry").when(excluded, "profile_excluded").when(unread, "unread_bound").when(failed, "parse_failed").otherwise("parsed"))
