"""WARC records in ZIP-packaged archives, written and range-read by tasks.

A package is a ZIP file with two stored (uncompressed) members: the records,
``archive/data.warc.gz``, each record its own gzip member, and their index,
``indexes/index.cdxj``, one line of JSON per record with its place. The reader
never extracts: it reads the end of the file, follows the ZIP64 locator if
there is one, parses the central directory, finds where each stored member's
bytes begin from its local header, reads the index, and then only the byte
ranges of the records asked for.

Packages lie in the shared folder, reached through Arrow's file systems (local,
HDFS, S3, ...). A task that runs again writes under a new name; only names in
the written list of packages count, so a lost executor leaves no half archive.

Edge cases: a null html is an empty payload; payloads under ``MIN_REVISIT``
bytes are all responses; rows that repeat the largest page_id of their payload
are all responses; a null url is written as ``urn:none``; an empty table writes no
package and reads no record; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import new_dir, opened, small, staged, text_batches

MIN_REVISIT = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures, and the mark of a field held in ZIP64.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATE = "2024-01-01T00:00:00Z"


class StoredZip:
    """Writes stored members one after the other, always with ZIP64 fields."""

    def __init__(self, out: io.RawIOBase) -> None:
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow in a data descriptor, as they are not known yet."""
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(raw), 20))
        self._put(raw + struct.pack("<2H2Q", 1, 16, 0, 0))
        self.start = self.at

    def write(self, data: bytes) -> None:
        self.members[-1][3] = zlib.crc32(data, self.members[-1][3])
        self._put(data)

    def end(self) -> None:
        m = self.members[-1]
        m[2] = self.at - self.start
        self._put(b"PK\x07\x08" + struct.pack("<I2Q", m[3], m[2], m[2]))

    def close(self) -> None:
        first = self.at
        for raw, at, size, crc in self.members:
            fixed = struct.pack("<6H3I5H2I", 45, 45, 8, 0, 0, 33, crc, FULL32, FULL32, len(raw), 28, 0, 0, 0, 0, FULL32)
            self._put(CENTRAL + fixed + raw + struct.pack("<2H3Q", 1, 24, size, size, at))
        size, n, end64 = self.at - first, len(self.members), self.at
        self._put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, size, first))
        self._put(LOCATOR + struct.pack("<IQI", 0, end64, 1))
        self._put(END + struct.pack("<4H2IH", FULL16, FULL16, FULL16, FULL16, FULL32, FULL32, 0))


def members(f: pa.NativeFile, size: int) -> dict[str, tuple[int, int]]:
    """(first byte, size) of each stored member, from the ZIP directories."""
    tail_at = max(0, size - 22 - FULL16 - 20)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("not a ZIP archive")
    n, length, first = struct.unpack("<H2I", tail[end + 10 : end + 20])
    if tail[max(0, end - 20) : end][:4] == LOCATOR:
        at64 = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        head = f.read_at(56, at64)
        if head[:4] != END64:
            raise ValueError("the ZIP64 locator points to no directory")
        n, length, first = struct.unpack("<3Q", head[32:56])
    directory, at, out = f.read_at(length, first), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
        packed, plain, n_name, n_extra, n_note = struct.unpack("<2I3H", directory[at + 20 : at + 34])
        where = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack("<2H", extra[:4])
            if kind == 1:  # holds, in this order, only the fields that are full
                wide = list(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                where = wide.pop(0) if where == FULL32 else where
            extra = extra[4 + k :]
        if method == 0:
            local = f.read_at(30, where)
            skip = sum(struct.unpack("<2H", local[26:30]))
            out[name] = (where + 30 + skip, packed)
        at += 46 + n_name + n_extra + n_note
    return out


def _record(row: dict, payload: bytes) -> bytes:
    """One WARC record; a revisit keeps the HTTP head of its capture only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    block = http if revisit else http + payload
    url = (row["url"] or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row['page_id']}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{row['digest']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{row['refers_to']}>",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): who is a revisit of whom."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
    )
    long = F.octet_length("html") >= MIN_REVISIT
    # digests of repeated payloads only, so that most pages meet no partner
    shared = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("__last"), F.count("*").alias("n"))
    shared = small(shared.where("n > 1").select(F.col("digest").alias("__digest"), "__last"))
    rows = rows.join(shared, (F.col("digest") == F.col("__digest")) & long, "left")
    other = F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last"))
    return rows.withColumn("refers_to", F.when(other, F.col("__last"))).drop("__digest", "__last")


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write packages, one or none per task; (package, records, bytes) of each."""
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped, index, uri, out = None, [], f"{folder}/{uuid.uuid4().hex}.wacz", None
        for b in batches:
            for row in b.to_pylist():
                if zipped is None:
                    fs, path = opened(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                    zipped = StoredZip(out)
                    zipped.begin(DATA)
                payload = row["html"].encode("utf-8", "surrogatepass")
                packed = gzip.compress(_record(row, payload), 5, mtime=0)
                index.append({"page_id": row["page_id"], "offset": zipped.at - zipped.start, "length": len(packed)})
                zipped.write(packed)
        if zipped is not None:
            zipped.end()
            zipped.begin(INDEX)
            for line in index:
                zipped.write(json.dumps(line).encode() + b"\n")
            zipped.end()
            zipped.close()
            out.close()
            found = {"package": [uri], "records": [len(index)], "bytes": [zipped.at]}
            yield pa.RecordBatch.from_pydict(found)

    rows = with_revisits(text_batches(pages)).select("page_id", "url", "html", "digest", "refers_to")
    return staged(rows.mapInArrow(run, "package string, records long, bytes long"), "packages")


def locate(packages: DataFrame) -> DataFrame:
    """(package, page_id, first, length): the byte range of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    found = members(f, f.size())
                    data, (at, size) = found[DATA][0], found[INDEX]
                    lines = [json.loads(x) for x in f.read_at(size, at).splitlines()]
                cols = {
                    "package": pa.array([uri] * len(lines), pa.string()),
                    "page_id": pa.array([x["page_id"] for x in lines], pa.int64()),
                    "first": pa.array([data + x["offset"] for x in lines], pa.int64()),
                    "length": pa.array([x["length"] for x in lines], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(cols)

    schema = "package string, page_id long, first long, length long"
    return packages.select("package").mapInArrow(run, schema)


def _parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC head, HTTP head and payload of one record."""
    fields = lambda head: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head.decode("utf-8", "surrogatepass"))
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode()), payload


def read(ranges: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, html).

    ``html`` is null for a revisit; size and digest are of the full payload.
    A response whose payload does not match its digest raises an error.
    """

    def number(urn: str) -> int | None:
        last = urn.strip("<>").rpartition(":")[2]
        return None if last == "None" else int(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[str, pa.NativeFile] | None = None
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for uri, first, length in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if current is None or current[0] != uri:
                    fs, path = opened(uri)
                    current = (uri, fs.open_input_file(path))
                warc, http, payload = _parse(gzip.decompress(current[1].read_at(length, first)))
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                revisit = warc["warc-type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload and digest differ in {uri} at {first}")
                row = (
                    number(warc["warc-record-id"]), warc["warc-type"], number(warc["warc-refers-to"]) if revisit else None,
                    int(http["content-length"]), digest, None if revisit else payload.decode("utf-8", "surrogatepass"),
                )
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    return ranges.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read every record back from the packages."""
    return read(locate(write(pages)))


def open_packages(spark: SparkSession, uris: list[str]) -> DataFrame:
    """Packages by name, for ``locate``."""
    return spark.createDataFrame([(u,) for u in uris], "package string")


def oracle() -> str:
    """The round trip of ``pages`` in SQL."""
    return f"""
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages))"""
