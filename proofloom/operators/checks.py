"""Small checks over ids and sets: weights left out, covering contexts, references, traces, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def excluded_weight(rows: DataFrame, excluded: Column) -> DataFrame:
    """One row (excluded, weight): how many rows are left out and what they weigh; 0 for none."""
    w = F.col("weight").cast("decimal(18,6)")
    return rows.agg(F.count_if(excluded).alias("excluded"), F.coalesce(F.sum(F.when(excluded, w)), F.lit(0)).cast("double").alias("weight"))


def visited_share(rows: DataFrame, stage: str, visited: Column) -> DataFrame:
    """(stage, ratio): the share of a stage's weight that is visited; 0 where it weighs nothing."""
    w = F.col("weight").cast("decimal(18,6)")
    sums = rows.groupBy(stage).agg(F.sum(F.when(visited, w).otherwise(0)).cast("double").alias("v"), F.sum(w).cast("double").alias("t"))
    return sums.select(stage, F.when(F.coalesce("t", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.round(F.col("v") / F.col("t"), 6)).alias("ratio"))


def touching_limitations(limitations: DataFrame, missing: DataFrame) -> DataFrame:
    """(limitation) of limitations(limitation, names array) that name a missing(capability)."""
    return limitations.select("limitation", F.explode("names").alias("capability")).join(missing.select("capability"), "capability", "left_semi").select("limitation").distinct()


def covering(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(context, item) where a context's members(context, member) hold every member of wanted(item, member): a division by counts."""
    need = wanted.select("item", "member").distinct()
    size = need.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    met = members.select("context", "member").distinct().join(need, "member").groupBy("context", "item").agg(F.count(F.lit(1)).alias("m"))
    return met.join(size, "item").where("m = n").select("context", "item")


def dangling(child: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(reference, n) per foreign key of child whose value has no parent; nulls refer to nothing."""
    out = None
    for column, (parent, key) in parents.items():
        lost = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
        row = lost.agg(F.lit(column).alias("reference"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def selected(index: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Index rows whose id is selected, each once as in the index."""
    return index.join(ids.select(key), key, "left_semi")


def shared_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row (shared, disjoint) of two id sets."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("shared"), (F.count(F.lit(1)) == 0).alias("disjoint"))


def restrictions(sections: DataFrame, anchors: DataFrame) -> DataFrame:
    """(pair, section, anchor) for each section of a pair that has an overlap anchor."""
    return sections.select("pair", "section").join(anchors.select("pair", "anchor"), "pair")


def traces(rows: DataFrame, by: str, items: str) -> DataFrame:
    """(by, trace): the sorted union of arrays of a group, joined by ','."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))), ",").alias("trace"))


def open_executions(executions: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Executions without an outcome."""
    return executions.join(outcomes.select(key), key, "left_anti")


def family_faults(families: DataFrame, members: DataFrame) -> DataFrame:
    """(family, fault) of accepted families(family, declared, evidence, verification): members repeated, a denominator that is not
    the number of members, or no evidence or verification."""
    sums = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("member").alias("d"))
    rows = families.join(sums, "family", "left").fillna(0, ["n", "d"])
    faults = F.array_compact(F.array(
        F.when(F.col("n") != F.col("d"), F.lit("member_repeated")), F.when(F.col("declared") != F.col("d"), F.lit("denominator_differs")),
        F.when(F.col("evidence") == 0, F.lit("evidence_missing")), F.when(F.col("verification") == 0, F.lit("verification_missing")),
    ))
    return rows.select("family", F.explode(faults).alias("fault"))


def bindings(imports: DataFrame, exports: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, declaration, outcome) of imports(id, file, name) through export slots(file, name, local) to declarations(file, name, k).

    No slot: export_binding_unsupported; several: import_binding_ambiguous; no declaration or several of the local name: unresolved_name.
    """
    slots = exports.groupBy("file", "name").agg(F.count(F.lit(1)).alias("s"), F.min("local").alias("local"))
    known = declared.groupBy("file", F.col("name").alias("local")).agg(F.count(F.lit(1)).alias("d"), F.min("k").alias("k"))
    rows = imports.join(slots, ["file", "name"], "left").join(known, ["file", "local"], "left")
    outcome = F.when(F.col("s").isNull(), "export_binding_unsupported").when(F.col("s") > 1, "import_binding_ambiguous").when(F.coalesce("d", F.lit(0)) != 1, "unresolved_name").otherwise("bound")
    return rows.select("id", F.when(outcome == "bound", F.col("k")).alias("declaration"), outcome.alias("outcome"))


def meets_lines(rows: DataFrame, lines: DataFrame, width: int = 64) -> DataFrame:
    """(k) of rows(k, path, s, e) whose closed range holds a changed line(path, line); joined by cells of `width` lines."""
    cells = rows.select("k", "path", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("cell"))
    return cells.join(lines.select("path", "line", F.floor(F.col("line") / width).alias("cell")), ["path", "cell"]).where("s <= line AND line <= e").select("k").distinct()
