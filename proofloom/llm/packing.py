"""Best-fit packing by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, hash_bucket, running, written
from .tokens import encoder
from .words import slices


def fill_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one bin, number of such bins) that use up counts.

    A bin starts with the longest length left; subset sums of the others, as bits of one integer,
    give the fullest combination for the room left. The combination is taken as often as
    the counts allow, then removed. Lengths are 1 to capacity, so the plan's size and the work
    depend on capacity alone, not on the number of pieces.
    """
    left, plan = dict(counts), []
    order = sorted((n for n in left if left[n]), reverse=True)
    while order:
        longest, room = order[0], capacity - order[0]
        reach, mask, steps = 1, (1 << (room + 1)) - 1, []
        for n in order:
            if n > room:
                continue
            for _ in range(min(left[n] - (n == longest), room // n)):
                grown = (reach | reach << n) & mask
                if grown == reach:
                    break
                steps.append((n, reach))
                reach = grown
            if reach >> room & 1:
                break
        at, chosen = reach.bit_length() - 1, [longest]
        for n, before in reversed(steps):
            if not before >> at & 1:
                chosen.append(n)
                at -= n
        used: dict[int, int] = {}
        for n in chosen:
            used[n] = used.get(n, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        plan.append((chosen, times))
        for n, k in used.items():
            left[n] -= k * times
        if any(not left[n] for n in used):
            order = [n for n in order if left[n]]
    return plan


def places(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per bin, first bin, first offset), sorted by length and rank."""
    rows, next_rank, next_bin = [], {}, 0
    for lengths, times in plan:
        at = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            rows.append((n, next_rank.get(n, 0), k, next_bin, at))
            next_rank[n] = next_rank.get(n, 0) + k * times
            at += k * n
        next_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document; only longer ones than capacity are cut.

    A null or empty text is one piece of the end id alone. Equal rows have pieces each; a null key stays null. Further
    columns of docs are not read.
    """

    def cut(parts):
        import pyarrow as pa

        enc = encoder(tokenizer)
        for batch in parts:
            for a, b in slices(batch.column(1)):
                ids, ends = enc.encode(batch.column(1)[a:b], end_id)
                ids, lengths = ids.astype("<u4"), np.diff(ends, prepend=0)
                counts = -(-lengths // capacity)
                of = np.repeat(np.arange(b - a), counts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(lengths[of] - start, capacity)
                at = (ends - lengths)[of] + start
                crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "key long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity.

    Only the histogram of lengths (capacity numbers at most) comes to the driver. Pieces of
    one length are ranked over hash buckets, so a length that a third of the pieces share is no hot group.
    """
    cut = written(cut, "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = places(fill_plan(counts, capacity))
    bits = bucket_bits(sum(counts.values()))
    hashed = cut.withColumn("_hash", F.xxhash64("key", "piece", "ids_crc32"))
    ranked = running(hashed.withColumn("_bucket", hash_bucket(F.col("_hash"), bits)), ["length"], "_bucket", [F.col("_hash"), F.col("key")], F.lit(1).cast("long"), "rank").drop("_bucket", "_hash")
    keyed = table[:, 0] * (1 << 44) + table[:, 1]

    def place(parts):
        import pyarrow as pa

        for batch in parts:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(keyed, n * (1 << 44) + rank, "right") - 1]
            rest = rank - row[:, 1]
            columns = [batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + rest // row[:, 2]), pa.array(row[:, 4] + rest % row[:, 2] * n)], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
