"""URL filters over a memory-mapped, sorted array of 64-bit digests.

Entries are strings ``host + path``: rules with a path, which allow or block,
and blocked hosts, which have none, both from tables. Spark range-sorts them by
their XXH64 (seed 42, unsigned) and tasks write the sorted parts to the shared
folder, from which Spark ships them to every executor. Tasks memory-map the
parts, probe all candidates of a batch (the host's suffixes times the path
lengths that rules have) by vectorised binary search, and compare the stored
string of each digest hit, so that a collision cannot decide.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest wins, of equally long ones a blocking one. Without a rule a url is
blocked if its host or a parent of it is a blocked host.

Edge cases: a null url, or one without ``://``, has an empty host and path and
is allowed; repeated rows get equal verdicts; repeated entries are one; an
empty list allows all; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import new_dir, opened, staged

SEED = 42
ENTRIES_PER_PART = 4_000_000
ALLOW, BLOCK, LISTED = 0, 1, 2
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Hosts known for spam, betting, adult content and tracking.
BLOCKED_HOSTS = [
    f"{name}.example.{top}"
    for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
    for top in ("com", "net", "org")
]
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def entries(spark: SparkSession, rules: list[tuple[str, str]], hosts: list[str] | DataFrame) -> DataFrame:
    """(entry, verdict) rows from rules (verdict, host/path) and blocked hosts: a
    list, or the first column of a table of any size."""
    rows = spark.createDataFrame([(e, BLOCK if v == "block" else ALLOW) for v, e in rules], "entry string, verdict int")
    if not isinstance(hosts, DataFrame):
        hosts = spark.createDataFrame([(h,) for h in hosts], "entry string")
    return rows.unionByName(hosts.select(F.lower(F.col(hosts.columns[0])).alias("entry"), F.lit(LISTED).alias("verdict")))


def build(table: DataFrame) -> list[str]:
    """Write the sorted array of ``entries`` in parts and ship them; their names, in order.

    A part: count, number of shapes, shapes (labels, path length), then the
    digests, the offsets of the strings, the verdicts and the strings.
    """
    spark = table.sparkSession
    rows = table.where(F.col("entry").isNotNull()).groupBy("entry").agg(F.max("verdict").alias("verdict"))
    rows = staged(rows, "entries")
    digest = F.xxhash64("entry")
    # unsigned order: non-negative digests first
    order = [(digest < 0), digest, F.col("entry")]
    rows = rows.repartitionByRange(1 + rows.count() // ENTRIES_PER_PART, *order).sortWithinPartitions(*order)
    folder = new_dir(spark, "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, verdicts, raws, shapes = [], [], [], set()
        for b in batches:
            for d, entry, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                host, slash, path = entry.partition("/")
                shapes.add((host.count(".") + 1, len(slash + path)))
                digests.append(d)
                verdicts.append(verdict)
                raws.append(entry.encode("utf-8", "surrogatepass"))
        if not raws:
            return
        name = f"{uuid.uuid4().hex}.bin"
        fs, path = opened(f"{folder}/{name}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(struct.pack("<qq", len(raws), len(shapes)))
            for shape in sorted(shapes):
                out.write(struct.pack("<qq", *shape))
            out.write(np.array(digests, "<i8").tobytes())
            out.write(np.cumsum([0, *map(len, raws)]).astype("<i8").tobytes())
            out.write(np.array(verdicts, "<i8").tobytes())
            out.write(b"".join(raws))
        first = digests[0] % 2**64
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [f"{first:016x}"]})

    # a row per part
    parts = staged(rows.select(digest, "entry", "verdict").mapInArrow(run, "name string, first string"), "parts").collect()
    names = [r["name"] for r in sorted(parts, key=lambda r: r["first"])]
    for name in names:
        spark.sparkContext.addFile(f"{folder}/{name}")
    return names


class DigestArray:
    """A mapped part, or several in the order of their digests."""

    def __init__(self, paths: list[str]) -> None:
        self.parts = [_Part(p) for p in paths]
        self.first = np.array([p.digests[0] for p in self.parts], np.uint64)
        self.shapes = sorted({s for p in self.parts for s in p.shapes})

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Verdict of each key, or -1."""
        found = np.full(len(keys), -1)
        digests = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
        # equal digests may begin in one part and end in the next
        lo, hi = np.searchsorted(self.first, digests, side="left") - 1, np.searchsorted(self.first, digests, side="right") - 1
        for i, part in enumerate(self.parts):
            mine = np.nonzero((lo <= i) & (i <= hi))[0]
            if len(mine):
                got = part.find([keys[k] for k in mine], digests[mine])
                found[mine] = np.maximum(found[mine], got)
        return found


class _Part:
    """One mapped file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            n, n_shapes = struct.unpack("<qq", f.read(16))
            self.shapes = [struct.unpack("<qq", f.read(16)) for _ in range(n_shapes)]
            at = f.tell()
        size = os.path.getsize(path)
        part = lambda kind, at, k: np.memmap(path, kind, "r", at, (k,)) if k else np.zeros(0, kind)
        self.digests = part("<u8", at, n)
        self.offsets = part("<i8", at + 8 * n, n + 1)
        self.verdicts = part("<i8", at + 16 * n + 8, n)
        self.strings = part("u1", at + 24 * n + 8, size - (at + 24 * n + 8))

    def find(self, keys: list[bytes], digests: np.ndarray) -> np.ndarray:
        """Verdict of each key, or -1; keys of equal digest are told apart by their strings."""
        found = np.full(len(keys), -1)
        at = np.searchsorted(self.digests, digests)
        inside = np.nonzero(at < len(self.digests))[0]
        for i in inside[self.digests[at[inside]] == digests[inside]]:
            j = at[i]
            while j < len(self.digests) and self.digests[j] == digests[i]:  # all strings of this digest
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]:
                    found[i] = self.verdicts[j]
                    break
                j += 1
        return found


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


def judge(array: DigestArray, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each url."""
    split = [host_and_path(u) for u in urls]
    owner: list[int] = []
    keys: list[bytes] = []
    for i, (host, path) in enumerate(split):
        labels = host.split(".")
        for n, length in array.shapes:
            if host and n <= len(labels) and length <= len(path):
                owner.append(i)
                keys.append((".".join(labels[-n:]) + path[:length]).encode("utf-8", "surrogatepass"))
    best: dict[int, tuple[int, int, str]] = {}
    listed = set()
    verdicts = array.find(keys)
    for k in np.nonzero(verdicts >= 0)[0]:
        if verdicts[k] == LISTED:
            listed.add(owner[k])
        else:
            rule = keys[k].decode("utf-8", "surrogatepass")
            best[owner[k]] = max(best.get(owner[k], (0, 0, "")), (len(rule), int(verdicts[k]), rule))
    out = []
    for i, (host, path) in enumerate(split):
        blocked = best[i][1] == BLOCK if i in best else i in listed
        out.append((host, path, best[i][2] if i in best else None, "block" if blocked else "allow"))
    return out


def filter_urls(pages: DataFrame, table: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page, by ``entries``."""
    names = build(table)
    mapped: list[DigestArray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not mapped:
            mapped.append(DigestArray([SparkFiles.get(n) for n in names]))
        for b in batches:
            got = judge(mapped[0], b.column(1).to_pylist())
            cols = [pa.array([g[k] for g in got], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col("page_id").cast("long"), "url")
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def oracle() -> str:
    """The same in SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{v}', '{e.partition('/')[0]}', '/{e.partition('/')[2]}')" for v, e in RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
hosts(h) AS (VALUES {hosts}),
cut AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL
                        ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
keyed AS (SELECT *, row_number() OVER () AS k FROM parts),
fits AS (SELECT k, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, verdict DESC) AS n
    FROM keyed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
bad AS (SELECT DISTINCT k FROM keyed JOIN hosts ON host = h OR ends_with(host, '.' || h))
SELECT page_id, host, path, fits.rule AS rule,
    coalesce(fits.verdict, CASE WHEN bad.k IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM keyed LEFT JOIN fits ON fits.k = keyed.k AND fits.n = 1 LEFT JOIN bad ON bad.k = keyed.k"""
