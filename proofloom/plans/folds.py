"""Folds in order under budgets, over ranges of a sort: no group is held by one task, however many rows it has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, written


def ordered(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """rows as a table in order within group (columns without nulls), with _at, which rises in that order, and _part, the range that a row lies in."""
    by = [*group, *order]
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ordered")


def summed(rows: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """ordered() rows with the running sum of value within group, the row's own included: sums of the ranges before, then within the range."""
    parts = rows.groupBy(*group, "_part").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum(value).over(Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_in", inner).join(parts.select(*group, "_part", before.alias("_before")), [*group, "_part"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in")


def taken(rows: DataFrame, group: list[str], size: str, budget: int) -> DataFrame:
    """(group, _at) of the ordered() rows that a fold takes: each whose size still fits what the rows taken before leave of budget.

    A round takes all rows up to the first that no longer fits; what is too large for the rest can't be taken later either, and falls out. So a round is
    a running sum over ranges, and rounds end when a rest of the rows fits whole. Sizes are 0 or more; a null size is never taken.
    """
    open_ = rows.where(F.col(size) <= budget).select(*group, "_part", "_at", F.col(size).cast("long").alias("_size"), F.lit(budget).cast("long").alias("_left"))
    found, held = [], None
    while True:
        sums = written(summed(open_, group, F.col("_size"), "_sum"), "fold")
        discard(held)
        first = sums.where("_sum > _left").groupBy(*group).agg(F.min("_at").alias("_over"))
        marked = written(sums.join(first, group, "left"), "fold")
        discard(sums)
        hit = marked.where("_over IS NULL OR _at < _over")
        found.append(written(hit.select(*group, "_at"), "taken"))
        left = marked.where("_over IS NOT NULL").groupBy(*group).agg((F.min("_left") - F.coalesce(F.max(F.when(F.col("_at") < F.col("_over"), F.col("_sum"))), F.lit(0))).alias("_rest"))
        rest = marked.where("_at > _over").join(left, group).where("_size <= _rest").select(*group, "_part", "_at", "_size", F.col("_rest").alias("_left"))
        if rest.isEmpty():
            discard(marked)
            return reduce(DataFrame.unionByName, found)
        open_, held = rest, marked


def bounded(files: DataFrame, group: str, order: str, size: str, most_bytes: int, most_total: int, most_files: int | None = None) -> DataFrame:
    """files with outcome: too_many_files from the most_files-th on in order, file_too_large, total_exceeded, or accepted.

    Only accepted sizes add up. order is unique within group; sizes aren't null.
    """
    rows = ordered(files, [group], [order])
    rows = written(summed(rows, [group], F.lit(1), "_place"), "placed") if most_files is not None else rows.withColumn("_place", F.lit(0))
    early = F.when(F.col("_place") > (most_files or 0), "too_many_files") if most_files is not None else F.lit(None).cast("string")
    early = F.coalesce(early, F.when(F.col(size) > most_bytes, "file_too_large"))
    hit = taken(rows.where(early.isNull()), [group], size, most_total).withColumn("_ok", F.lit(True))
    outcome = F.coalesce(early, F.when(F.col("_ok"), "accepted").otherwise("total_exceeded"))
    return rows.join(hit, [group, "_at"], "left").select(*files.columns, outcome.alias("outcome"))
