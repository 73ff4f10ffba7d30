"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks.

Each source's documents form one shuffled stream, cut into blocks of `block` words. Slot i of the
schedule falls at the fraction of i / golden ratio; the cumulative targets map it to a source, and the
rank of the slot within its source says which block it takes, epoch after epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bucket_bits, hash_bucket, running, written

#: 2**64 / golden ratio, odd.
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 12


def size_of(text) -> F.Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets that share `share` of all sizes by weight; none over `most` times its size, the excess reshared."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / (sum(weights[i] for i in open_) or 1)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    words: int
    blocks: int
    slots: int


def plan(totals: list[tuple[str | None, int]], weights=(3, 1, 2), block: int = 512, share: float = 1.5, most: float = 2.0) -> list[Source]:
    """Sources by code point, null last, with weights in turn; words = the target in whole words."""
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    targets = water_fill([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    out = []
    for (name, n), t in zip(totals, targets):
        words = min(int(round(t)), int(most * n))
        blocks = -(-n // block)
        whole, rest = divmod(words, n) if n else (0, 0)
        out.append(Source(name, n, t, words, blocks, whole * blocks + -(-rest // block)))
    return out


def schedule(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(slot, source, rank): every source gets exactly its slots; ranks are gapless from 0.

    Slots are mapped in parallel; ranks come from counts per chunk of slots. The few slots that the points
    give a source beyond its need go to the sources that the points left short (at most a
    logarithm of the slots for each source; these alone come to the driver).
    """
    n = sum(s.slots for s in sources)
    need = np.array([s.slots for s in sources], np.int64)
    bounds = (np.cumsum(need) / max(1, n) * float(1 << 64)).astype(np.float64)
    parts = max(1, min(-(-n // CHUNK), max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def map_slots(batches):
        import pyarrow as pa

        for batch in batches:
            slot = batch.column(0).to_numpy()
            with np.errstate(over="ignore"):
                point = (slot.astype(np.uint64) * _STEP).astype(np.float64)
            source = np.minimum(np.searchsorted(bounds, point, "right"), len(need) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(source.astype(np.int32)), pa.array(slot // CHUNK)], ["slot", "source", "chunk"])

    slots = spark.range(0, n, 1, parts).mapInArrow(map_slots, "slot long, source int, chunk long")
    ranked = written(running(slots, ["source"], "chunk", [F.col("slot")], F.lit(1).cast("long"), "rank").select("slot", "source", "rank"), "schedule")
    needs = F.element_at(F.array(*[F.lit(int(x)) for x in need]), F.col("source") + 1).cast("long") if len(need) else F.lit(0)
    spare = [r[0] for r in ranked.where(F.col("rank") >= needs).select("slot").orderBy("slot").collect()]
    if not spare:
        return ranked
    got = {r[0]: r[1] for r in ranked.groupBy("source").count().collect()}
    short = [(i, k) for i in range(len(need)) for k in range(got.get(i, 0), int(need[i]))]
    moved = [(slot, i, k) for slot, (i, k) in zip(spare, short)]
    return ranked.where(F.col("rank") < needs).union(spark.createDataFrame(moved, "slot long, source int, rank long"))


def streams(docs: DataFrame, keys: list[str], source: str, size: str, seed: int = 0) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """Rows with `begin`, their place in the shuffled stream of their source, and the sources' sizes."""
    rows = docs.withColumns({"_source": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")), "_hash": F.xxhash64(F.lit(seed), *keys)})
    rows = written(rows, "sizes")
    totals = [(r[0][1:] if r[0][0] == "s" else None, r[1]) for r in rows.groupBy("_source").agg(F.sum(size)).collect()]
    rows = rows.withColumn("_bucket", hash_bucket(F.col("_hash"), bucket_bits(rows.count())))
    order = [F.col("_hash"), *[F.col(k) for k in keys]]
    return written(running(rows, ["_source"], "_bucket", order, F.col(size), "begin").drop("_bucket", "_hash"), "streams"), totals


def spans(placed: DataFrame, sources: list[Source], size: str, block: int = 512) -> DataFrame:
    """placed rows once for every slot that takes words of them: slot, epoch, first and last (excluded) word."""
    spark = placed.sparkSession
    tagged = {("n" if s.name is None else f"s{s.name}"): i for i, s in enumerate(sources)}
    dim = spark.createDataFrame([(k, i, sources[i].size, sources[i].words, sources[i].blocks) for k, i in tagged.items()], "_source string, source_no int, stream long, words long, blocks long")
    rows = placed.where(F.col(size) > 0).join(dim, "_source")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("begin") + F.col(size) - 1) / block).cast("long"))))
    slots = schedule(spark, sources).join(dim.select("source_no", F.col("blocks").alias("_n")), F.col("source") == F.col("source_no")).where("_n > 0")
    slots = slots.select("slot", F.col("source").alias("source_no"), (F.col("rank") % F.col("_n")).alias("_block"), F.floor(F.col("rank") / F.col("_n")).cast("long").alias("epoch"))
    joined = rows.join(slots, ["source_no", "_block"])
    end = F.least((F.col("_block") + 1) * block, F.col("stream"), F.col("words") - F.col("epoch") * F.col("stream"))
    first = F.greatest(F.col("begin"), F.col("_block") * block) - F.col("begin")
    last = F.least(F.col("begin") + F.col(size), end) - F.col("begin")
    return joined.withColumns({"first": first, "last": last}).where("last > first").drop("stream", "words", "blocks", "_block")


def mix(docs: DataFrame, keys: list[str], source: str, size: str, weights=(3, 1, 2), block: int = 512) -> tuple[DataFrame, DataFrame, list[Source]]:
    """(placed rows, spans of the mix, plan). Rows of size 0 are placed and never taken; null sources are one source.

    The plan holds one entry a source and is made on the driver. Reruns agree: order comes from hashes of the keys.
    """
    placed, totals = streams(docs, keys, source, size)
    chosen = plan(totals, weights, block)
    return placed, spans(placed, chosen, size, block), chosen


def taken(placed: DataFrame, used: DataFrame, sources: list[Source], size: str) -> DataFrame:
    """placed rows with target (their source's) and taken (words the mix takes of them, repeats counted)."""
    spark = placed.sparkSession
    sums = used.groupBy("_source", "begin").agg(F.sum(F.col("last") - F.col("first")).alias("_taken"))
    dim = spark.createDataFrame([("n" if s.name is None else f"s{s.name}", s.size, s.target) for s in sources], "_source string, source_size long, target double")
    sums = sums.withColumn("_some", F.lit(True))
    rows = placed.withColumn("_some", F.col(size) > 0).join(sums, ["_source", "begin", "_some"], "left").join(dim, "_source")
    return rows.withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_taken", "_some")


def mixed_texts(docs: DataFrame, block: int = 512) -> DataFrame:
    """The mix as documents: a row per document and epoch with the words taken, joined by blanks when cut.

    Columns are those of docs (doc_id, text, source needed; n_chars is set anew if it is there).
    """
    names = docs.columns
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), "source", size_of(F.col("text")).alias("size"))
    _, used, _ = mix(rows, ["doc_id", "_text"], "source", "size", block=block)
    pieces = used.groupBy("doc_id", "_text", "source", "begin", "size", "epoch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    whole = docs.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text", "source"])
    on = [pieces[c].eqNullSafe(whole[c]) for c in ("doc_id", "_text", "source")]
    joined = whole.join(pieces.select("doc_id", "_text", "source", "size", "first", "last"), on)
    cut = F.array_join(F.slice(F.regexp_extract_all(whole["text"], F.lit(WORD), 0), (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), " ")
    text = F.when((F.col("first") == 0) & (F.col("last") == F.col("size")), whole["text"]).otherwise(cut)
    out = joined.select(*[text.alias("text") if c == "text" else whole[c] for c in names])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
