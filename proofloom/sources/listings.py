"""Parsers of version-control listings and patches: text columns in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_tree(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """NUL-separated `mode type oid<TAB>path` entries as rows; regular tells files from symlinks and submodules."""
    entry = F.explode(F.filter(F.split(F.col(raw), "\0"), lambda x: x != ""))
    rows = df.select(*keep, entry.alias("e"))
    part = lambda i: F.regexp_extract("e", r"(?s)^(\d+) (\w+) ([0-9a-f]+)\t(.*)$", i)
    rows = rows.select(*keep, part(1).alias("mode"), part(2).alias("type"), part(3).alias("oid"), part(4).alias("path"))
    return rows.withColumn("regular", F.col("mode").isin("100644", "100755"))


def parse_changes(df: DataFrame, raw: str) -> DataFrame:
    """NUL-separated name-status fields: (status, old_path, path); renames and copies have two paths.

    A field is a status if it is a letter, or R or C with a score, and stands where an entry begins: entries are cut by a
    pattern over the whole text, so no list is built up field by field.
    """
    entry = F.explode(F.regexp_extract_all(F.concat(F.col(raw), F.lit("\0")), F.lit("(?s)[RC][0-9]*\0[^\0]+\0[^\0]+\0|[A-QS-Z][0-9]*\0[^\0]+\0"), 0))
    fields = F.split("e", "\0")
    rows = df.select(entry.alias("e")).select(F.substring(fields[0], 1, 1).alias("status"), fields[1].alias("old_path"), F.when(F.size(fields) > 3, fields[2]).otherwise(fields[1]).alias("path"))
    return rows


def split_patches(df: DataFrame, raw: str) -> DataFrame:
    """(path, patch) per file of a unified diff: cut at lines that begin with 'diff '; the path is that of the +++ line, or of --- if the file went."""
    part = F.explode(F.filter(F.split(F.concat(F.lit("\n"), F.col(raw)), "\ndiff "), lambda x: x.contains("\n+++ ")))
    rows = df.select(part.alias("patch"))
    new, old = F.regexp_extract("patch", r"(?m)^\+\+\+ (?:b/)?(.*)$", 1), F.regexp_extract("patch", r"(?m)^--- (?:a/)?(.*)$", 1)
    return rows.select(F.when(new == "/dev/null", old).otherwise(new).alias("path"), "patch")


def changed_lines(df: DataFrame, patch: str, *keep: str) -> DataFrame:
    """(keep, line): every changed line of a zero-context patch, a row each."""
    return parse_hunks(df, patch).select(*keep, F.explode("ranges").alias("r")).select(*keep, F.explode(F.sequence("r.start", "r.end")).alias("line")).distinct()


def parse_hunks(df: DataFrame, patch: str) -> DataFrame:
    """df with ranges (start, end of added lines) and deletions (line after which lines went) of a zero-context patch."""
    heads = F.regexp_extract_all(F.col(patch), F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), 1)
    parsed = F.transform(heads, lambda h: F.struct(F.element_at(F.split(h, ","), 1).cast("int").alias("s"), F.coalesce(F.get(F.split(h, ","), 1).cast("int"), F.lit(1)).alias("n")))
    ranges = F.transform(F.filter(parsed, lambda p: p["n"] > 0), lambda p: F.struct(p["s"].alias("start"), (p["s"] + p["n"] - 1).alias("end")))
    return df.withColumn("ranges", ranges).withColumn("deletions", F.transform(F.filter(parsed, lambda p: p["n"] == 0), lambda p: p["s"]))


def cross_check(named: DataFrame, patched: DataFrame) -> DataFrame:
    """(path, status): ok, patch_missing (listed but without a patch) or unlisted; nothing is silently lost."""
    joined = named.select("path", F.lit(True).alias("n")).distinct().join(patched.select("path", F.lit(True).alias("p")).distinct(), "path", "full_outer")
    return joined.select("path", F.when(F.col("n") & F.col("p"), "ok").when(F.col("n"), "patch_missing").otherwise("unlisted").alias("status"))


def admitted(files: DataFrame, group: str, path: str, size: str, most_bytes: int, most_total: int, most_files: int | None = None) -> DataFrame:
    """Bounded read in path order within group: accepted, file_too_large, total_exceeded or too_many_files.

    Refused sizes do not add up, so a row depends on all before it: a fold in path order. The state is a total and a count, held
    by struct; the order is that of the sorted array, whose outcomes are zipped back. Groups are snapshots, bounded by their
    own file limit.
    """
    items = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col(size).cast("long").alias("size")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("files"), F.lit("").alias("out"))
    most = F.lit(most_files) if most_files is not None else F.lit((1 << 31) - 1)
    names = F.array(F.lit("accepted"), F.lit("file_too_large"), F.lit("total_exceeded"), F.lit("too_many_files"))

    def step(a: Column, x: Column) -> Column:
        code = F.when(a["files"] >= most, "4").when(x["size"] > most_bytes, "2").when(a["total"] + x["size"] > most_total, "3").otherwise("1")
        return F.struct((a["total"] + F.when(code == "1", x["size"]).otherwise(0)).alias("total"), (a["files"] + F.when(code == "1", 1).otherwise(0)).alias("files"), F.concat(a["out"], code).alias("out"))

    coded = items.select(group, "items", F.aggregate("items", zero, step)["out"].alias("codes"))
    rows = coded.select(group, "codes", F.posexplode("items").alias("at", "item"))
    return rows.select(group, "item.path", "item.size", F.element_at(names, F.substring("codes", F.col("at") + 1, F.lit(1)).cast("int")).alias("outcome"))


def chain_breaks(events: DataFrame, sequence: str, own_hash: str, previous_hash: str, stream: str) -> DataFrame:
    """Events whose previous hash is not the hash of the event before, or whose sequence has a gap."""
    w = Window.partitionBy(stream).orderBy(sequence)
    rows = events.withColumns({"_hash": F.lag(own_hash).over(w), "_seq": F.lag(sequence).over(w)})
    broken = ~F.col(previous_hash).eqNullSafe(F.col("_hash")) | (F.col(sequence) != F.coalesce(F.col("_seq") + 1, F.col(sequence)))
    return rows.where(broken).drop("_hash", "_seq")
