"""Folds of the append-only event log: in batch by windows, as a stream by keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import TRANSITIONS


def transition_violations(events: DataFrame) -> DataFrame:
    """Events whose step from the state before (per stream, by sequence) is not legal; first events pass."""
    legal = F.broadcast(events.sparkSession.createDataFrame(TRANSITIONS, "before string, state string"))
    rows = events.withColumn("before", F.lag("state").over(Window.partitionBy("stream").orderBy("seq")))
    return rows.where("before IS NOT NULL").join(legal, ["before", "state"], "left_anti").select("seq", "stream", "before", "state")


def latest(events: DataFrame) -> DataFrame:
    """Last state of each stream, of equal sequence numbers the greatest state; max merges before the shuffle."""
    sums = events.groupBy("stream").agg(F.max(F.struct("seq", "state")).alias("last"), F.count(F.lit(1)).alias("n"))
    return sums.select("stream", F.col("last.state").alias("state"), F.col("last.seq").alias("seq"), "n")


def stream_latest(events: DataFrame) -> DataFrame:
    """latest() over a streaming DataFrame (update mode): the state is one row per stream. Steps are not checked here: transition_violations() is for the batch."""
    return events.groupBy("stream").agg(F.max(F.struct("seq", "state")).alias("last")).select("stream", "last.state", "last.seq")
