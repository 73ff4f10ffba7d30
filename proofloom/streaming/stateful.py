"""The lifecycle as a stateful stream: each event is judged against the state kept for its stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from ..model import TRANSITIONS
from ..store import fresh_path

_OUT = "stream long, seq long, before string, state string, outcome string"
_KEPT = "seq long, state string"


def judged(events: DataFrame) -> DataFrame:
    """(stream, seq, before, state, outcome) for every event of a streaming DataFrame (stream, seq, state), append mode.

    The state of a stream is its last sequence number and state. Events of a micro-batch are taken in the order of seq (of equal ones, of state): the first
    of a stream is `first`, a step that the lifecycle allows `legal`, another `illegal`; both move the state on, as in the batch fold.
    An event whose number isn't above the last one is a replay or comes too late: `behind`, and moves nothing. Null streams are one
    stream. Restarted from its checkpoint, a stream goes on from the states kept.
    """
    legal = frozenset(TRANSITIONS)

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        seq, state = kept.get if kept.exists else (None, None)
        rows = sorted((int(s), x) for f in frames for s, x in zip(f["seq"], f["state"]))
        out = []
        for s, x in rows:
            if seq is not None and s <= seq:
                out.append((key[0], s, None, x, "behind"))
                continue
            out.append((key[0], s, state, x, "first" if seq is None else "legal" if (state, x) in legal else "illegal"))
            seq, state = s, x
        kept.update((seq, state))
        yield pd.DataFrame(out, columns=["stream", "seq", "before", "state", "outcome"])

    return events.select("stream", "seq", "state").groupBy("stream").applyInPandasWithState(step, _OUT, _KEPT, "append", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, events: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """judged() of all that a streaming DataFrame has now, as a table; out and checkpoint of a run before let it go on from there."""
    out, checkpoint = out or fresh_path(spark, "judged"), checkpoint or fresh_path(spark, "judged-checkpoint")
    judged(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_OUT).parquet(out)
