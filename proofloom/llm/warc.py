"""WARC records in ZIP archives of stored members, and a reader that fetches records by range.

The writer packs gzip records into `archive/data.warc.gz` and their places into `indexes/index.cdx`;
both members are stored, not deflated, so a record is a range of the archive. The reader
parses the end record, its ZIP64 form where a field is full, and the central directory.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written
from .token_files import opened, put

FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
#: Fixed date of every record: reruns write equal bytes.
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, uri: str, payload: bytes, sha1: str, refers_to: str | None, size: int, target: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but keeps its digest and size. target: the page's address (none: uri), control characters escaped."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in target) if target else uri
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{uri}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Bytes", str(size))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members; zip64 writes the wide fields even where they are not needed."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        wide = zip64 or max(len(data), at) >= FULL32
        small = FULL32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 33, crc, small, small, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra
    start, n = len(out), len(members)
    out += central
    wide = zip64 or n >= FULL16 or max(start, len(central)) >= FULL32
    if wide:
        end64 = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), start)
        out += struct.pack("<IIQI", 0x07064B50, 0, end64, 1)
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *([FULL16] * 2 if wide else [n, n]), *([FULL32] * 2 if wide else [len(central), start]), 0)
    return bytes(out)


class ZipArchive:
    """Stored members of a seekable file, read by range; nothing is extracted."""

    def __init__(self, file):
        self.file, self.size = file, file.seek(0, 2) or file.tell()
        tail_at = max(0, self.size - 22 - 65535)
        tail = self._read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == n or FULL32 in (length, start):
            where = struct.unpack("<IIQI", self._read(tail_at + at - 20, 20))
            if where[0] != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            n, length, start = struct.unpack_from("<QQQ", self._read(where[2], 56), 32)
        self.members, directory, p = {}, self._read(start, length), 0
        for _ in range(n):
            sign, _, _, _, method, _, _, crc, packed, whole, a, b, c, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
            if sign != 0x02014B50:
                raise ValueError("central directory is damaged")
            name, extra = directory[p + 46 : p + 46 + a].decode(), directory[p + 46 + a : p + 46 + a + b]
            whole, packed, local = self._wide(extra, whole, packed, local)
            self.members[name] = (method, packed, whole, local, crc)
            p += 46 + a + b + c

    @staticmethod
    def _wide(extra: bytes, *fields: int) -> list[int]:
        """Fields that are full are in the ZIP64 extra, in this order."""
        values, p, out = b"", 0, []
        while p + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, p)
            if tag == 1:
                values = extra[p + 4 : p + 4 + n]
            p += 4 + n
        for x in fields:
            if x == FULL32:
                x, values = struct.unpack_from("<Q", values)[0], values[8:]
            out.append(x)
        return out

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def range(self, name: str, begin: int, length: int) -> bytes:
        """Bytes begin to begin + length of a stored member."""
        method, packed, _, local, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        if begin < 0 or begin + length > packed:
            raise ValueError("outside the member")
        a, b = struct.unpack("<HH", self._read(local + 26, 4))
        return self._read(local + 30 + a + b + begin, length)

    def whole(self, name: str) -> bytes:
        data = self.range(name, 0, self.members[name][2])
        if zlib.crc32(data) != self.members[name][4]:
            raise ValueError(f"{name} is damaged")
        return data


DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, archive_bytes: int = 8 << 20) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns (path, n) per archive.

    Payloads: html in UTF-8, a null is empty. Of rows whose equal payloads have least_bytes or
    more, those with the largest page_id are responses and the others revisit it; if all ids
    are null, all are responses. Rows are matched by digest through a join, whose hot
    digests Spark splits; archives are written where the rows are.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    best = rows.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "top")
    rows = rows.join(best, "sha1", "left")
    revisit = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "sha1", F.col("size").cast("long").alias("size"), F.when(revisit, F.col("top")).alias("refers_to"))

    def write(parts):
        import pyarrow as pa
        import pyspark

        # attempts of one task may hold other rows, so none writes over another's archives
        part, n = f"{pyspark.TaskContext.get().partitionId():08d}-{pyspark.TaskContext.get().taskAttemptId()}", 0
        data, index, keys = bytearray(), [], 0

        def flush():
            nonlocal n, data, index, keys
            path = f"{folder}/{part}-{n:06d}.zip"
            put(path, zip_stored([(DATA, bytes(data)), (INDEX, "".join(json.dumps(x) + "\n" for x in index).encode())], zip64=n % 2 == 1))
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([keys], pa.int64())], ["path", "n"])
            n, data, index, keys = n + 1, bytearray(), [], 0
            return row

        for batch in parts:
            for x in batch.to_pylist():
                to = None if x["refers_to"] is None else f"urn:page:{x['refers_to']}"
                one = gzip.compress(record("response" if to is None else "revisit", f"urn:page:{x['page_id']}", x["payload"] or b"", x["sha1"], to, x["size"], x["url"]), 1, mtime=0)
                index.append([x["page_id"], x["url"], len(data), len(one)])
                data += one
                keys += 1
                if len(data) >= archive_bytes:
                    yield flush()
        if keys:
            yield flush()

    return written(rows.mapInArrow(write, "path string, n long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record, fetched by its range.

    Digests of responses are taken from the payload read; a revisit's come from its header,
    as its payload is that of the record it refers to. An empty table of archives gives no rows.
    """

    def read(parts):
        import pyarrow as pa

        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in parts:
            for path in batch.column("path").to_pylist():
                out = []
                with opened(path) as f:
                    zipped = ZipArchive(f)
                    for line in zipped.whole(INDEX).decode().splitlines():
                        page, _, begin, length = json.loads(line)
                        fields, payload = parse_record(gzip.decompress(zipped.range(DATA, begin, length)))
                        kind, told = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        sha1 = hashlib.sha1(payload).hexdigest() if kind == "response" else told
                        if sha1 != told:
                            raise ValueError(f"{path}: payload of page {page} is damaged")
                        to = fields.get("warc-refers-to")
                        out.append((page, len(payload) if kind == "response" else int(fields["x-payload-bytes"]), sha1, kind, to and int(to[len("<urn:page:") : -1])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], list(types))

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.repartition(n, "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, fresh_path(spark, "warc")))
