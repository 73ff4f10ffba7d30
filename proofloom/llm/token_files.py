"""Token ids in files of directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of `bits` bits, low chunk first. Level k holds chunk k of the ids that
reach it, a bitmap tells which of them go on to level k + 1, and a rank directory counts the set
bits before every 512th, so the place in the next level is found by a count over at most 512 bits.

File: b"DACT", version, bits, number of levels, documents, tokens; the documents' ends (u64), keys (i64) and which keys there are
(bits); per level: entries, chunks (u8), bitmap, directory (u64). All numbers are little-endian. A reader needs the head and, per level,
the few bytes that a range of tokens lies in.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_bits, fresh_path, written
from .tokens import encoder
from .words import slices

MAGIC, VERSION, BLOCK = b"DACT", 1, 512


def pack(ids: np.ndarray, ends: np.ndarray, bits: int = 8, keys: list[int | None] | None = None) -> bytes:
    """One file of ids (uint32), of the documents' ends among them and of the documents' keys (their places where none are given)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, higher = (rest & ((1 << bits) - 1)).astype(np.uint8), rest >> bits
        on = higher > 0
        counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint64) if len(on) else np.zeros(0, np.uint64)
        rank = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append(struct.pack("<Q", len(rest)) + chunk.tobytes() + np.packbits(on, bitorder="little").tobytes() + rank.astype("<u8").tobytes())
        rest = higher[on]
        if not len(rest):
            break
    head = MAGIC + struct.pack("<BBHQQ", VERSION, bits, len(levels), len(ends), len(ids))
    keys = list(range(len(ends))) if keys is None else keys
    known = np.packbits(np.array([k is not None for k in keys], bool), bitorder="little").tobytes()
    return head + ends.astype("<u8").tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + known + b"".join(levels)


def _parts(read, at: int) -> tuple[int, int, int]:
    """Entries of the level at a place of the file, where its chunks begin, where the next level begins."""
    (n,) = struct.unpack("<Q", read(at, 8))
    return n, at + 8, at + 8 + n + -(-n // 8) + 8 * (-(-n // BLOCK) + 1)


class TokenFile:
    """Random access to the ids of a file: its bytes, or a seekable file of which only the head and what is asked for is read."""

    def __init__(self, source):
        self.read = (lambda at, n: source[at : at + n]) if isinstance(source, bytes) else (lambda at, n: source.seek(at) and None or source.read(n))
        head = self.read(0, 24)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        _, self.bits, n_levels, n_docs, self.n_tokens = struct.unpack_from("<BBHQQ", head, 4)
        rest = self.read(24, 16 * n_docs + -(-n_docs // 8))
        self.ends = np.frombuffer(rest, "<u8", n_docs).astype(np.int64)
        known = np.unpackbits(np.frombuffer(rest, np.uint8, offset=16 * n_docs), bitorder="little")
        self.keys = [k if there else None for k, there in zip(np.frombuffer(rest, "<i8", n_docs, 8 * n_docs).tolist(), known.tolist())]
        self.levels, at = [], 24 + len(rest)
        for _ in range(n_levels):
            n, begin, at = _parts(self.read, at)
            self.levels.append((n, begin))

    def _bits(self, level: int, begin: int, end: int) -> np.ndarray:
        """Which of the entries begin to end (excluded) go on to the next level."""
        n, at = self.levels[level]
        data = self.read(at + n + begin // 8, -(-end // 8) - begin // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[begin % 8 : begin % 8 + end - begin].astype(bool)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before i."""
        n, at = self.levels[level]
        block = i // BLOCK
        (before,) = struct.unpack("<Q", self.read(at + n + -(-n // 8) + 8 * block, 8))
        return before + int(self._bits(level, block * BLOCK, i).sum())

    def range(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end (excluded): each level is read from the place its rank gives."""
        out = np.zeros(end - begin, np.uint32)
        at, i, n = np.arange(end - begin), begin, end - begin
        for level, (_, chunks) in enumerate(self.levels):
            if not n:
                break
            out[at] |= np.frombuffer(self.read(chunks + i, n), np.uint8).astype(np.uint32) << np.uint32(level * self.bits)
            on = self._bits(level, i, i + n)
            i, at = self._rank(level, i), at[on]
            n = len(at)
        return out

    def token(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def put(path: str, data: bytes) -> None:
    """Writes data to path under a name of its own first, so a repeated or lost task leaves no half file."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(tmp := f"{at}.{uuid.uuid4().hex}.tmp") as f:
        f.write(data)
    store.move(tmp, at)


def opened(path: str):
    """A seekable file of the shared store."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def write_files(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str, file_bytes: int = 4 << 20) -> DataFrame:
    """Writes the ids of every text, in ascending key order over all files, with the keys; returns (file, path), file rising in that order.

    Rows are split by ranges of (key, hash of text), so equal keys do not meet in one task, and
    each task writes files of about file_bytes of ids, each text whole in one file. Null keys come first, null texts are empty. Other columns are not read.
    """
    import pyspark

    def encode(parts):
        part, n = pyspark.TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        keys, ids, ends, held = [], [], [], 0

        def flush():
            nonlocal n, keys, ids, ends, held
            path = f"{folder}/{part:08d}-{n:06d}.dact"
            lengths = np.concatenate([np.diff(e, prepend=0) for e in ends])
            put(path, pack(np.concatenate(ids), np.cumsum(lengths), keys=np.concatenate(keys).tolist()))
            row = pa.RecordBatch.from_arrays([pa.array([part * 1_000_000 + n]), pa.array([path])], ["file", "path"])
            n, keys, ids, ends, held = n + 1, [], [], [], 0
            return row

        import pyarrow as pa

        for batch in parts:
            for a, b in slices(batch.column(1)):
                got, end = enc.encode(batch.column(1)[a:b], end_id)
                keys.append(np.array(batch.column(0)[a:b].to_pylist(), object))
                ids.append(got)
                ends.append(end)
                held += 4 * len(got)
                if held >= file_bytes:
                    yield flush()
        if keys:
            yield flush()

    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << bucket_bits(docs.select(key).count(), 2048))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ranged = rows.repartitionByRange(n, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))
    return written(ranged.mapInArrow(encode, "file long, path string"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document from the files themselves: their heads tell how many tokens each holds, and so where it starts."""
    from pyspark.sql import Window

    def heads(parts):
        import pyarrow as pa

        for batch in parts:
            counts = []
            for path in batch.column(1).to_pylist():
                with opened(path) as f:
                    counts.append(struct.unpack_from("<BBHQQ", f.read(24), 4)[4])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["file", "path", "n_tokens"])

    def decode(parts):
        import pyarrow as pa

        for batch in parts:
            for path, before in zip(*(batch.column(c).to_pylist() for c in ("path", "before"))):
                with opened(path) as f:
                    held = TokenFile(f.read())  # all of it is asked for
                begins = np.concatenate([[0], held.ends[:-1]]).astype(np.int64) if len(held.ends) else np.zeros(0, np.int64)
                crc = [zlib.crc32(held.document(i).astype("<u4").tobytes()) for i in range(len(held.ends))]
                yield pa.RecordBatch.from_arrays([pa.array(held.keys, pa.int64()), pa.array(begins + before), pa.array(held.ends - begins), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(files.select("file", "path").repartition(n, "file").mapInArrow(heads, "file long, path string, n_tokens long"), "token-heads")
    rows = found.withColumn("_group", F.floor(F.col("file") / 4096 / 1_000_000).cast("long"))
    sums = rows.groupBy("_group").agg(F.sum("n_tokens").alias("_n"))
    w = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_group", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("_in")).join(sums, "_group")
    rows = rows.select("file", "path", (F.col("_base") + F.col("_in")).alias("before"))
    return rows.repartition(n, "file").mapInArrow(decode, "key long, start long, n_tokens long, ids_crc32 long")


def encode_table(spark: SparkSession, docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    return read_files(write_files(docs, key, text, tokenizer, end_id, fresh_path(spark, "tokens")))
