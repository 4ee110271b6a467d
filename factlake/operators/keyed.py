"""A stored table that batches change bucket by bucket.

Rows lie in buckets by the leading bits of a hash of their key. A bucket holds at most
``most`` rows: one that grows beyond is split by further bits when a batch comes to it.
With each bucket lies a Bloom filter of its keys. Of the buckets a batch comes to, only
those that may hold one of its keys are read and written again; the others get one more
file. So what a batch reads follows from its own size, not from that of the table.

A table is a value: ``upsert`` returns the next one and leaves this one as it is. Files
are never changed, and a list of buckets is saved under a name; who writes that name down
last, in one row, makes a change that either happened or did not. One writer at a time.

The list of buckets is held by the driver: one entry for each ``most`` rows or fewer.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.staging import new_dir, small, staged

#: Files of a bucket after which it is written as one.
PARTS = 8
#: A filter of ten bits a key, seven of them set, lets about 1 in 100 unknown keys pass.
BITS_A_KEY, SET = 10, 7
#: Bits of one stored bitmap: what Spark's bitmap functions build.
BITMAP = 32_768

#: (rows there were, rows of the batch) to (rows there are, anything to report). It may
#: look at rows of equal keys together, but not at others: those may not be there.
Rule = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


@dataclass(frozen=True)
class Bucket:
    bits: str = ""
    parts: tuple[str, ...] = ()
    n: int = 0

    @property
    def name(self) -> str:
        return f"b{self.bits}"


class KeyedTable:
    """``keys`` are columns or expressions of ``schema``; rows of equal keys share a bucket."""

    def __init__(self, spark: SparkSession, keys: list[str | Column], schema: str, path: str | None = None, most: int = 1_000_000, buckets: Iterable[Bucket] = (Bucket(),)) -> None:
        self.spark, self.keys, self.schema, self.most = spark, keys, schema, most
        self.path = path or new_dir(spark, "keyed")
        self.buckets = list(buckets)
        self.types = spark.createDataFrame([], schema).schema
        self.columns = self.types.names
        self.bits = math.ceil(most * BITS_A_KEY / BITMAP) * BITMAP
        #: Rows of the buckets that were opened: to come to this table from the one before, and by lookups since.
        self.opened = 0

    # ---- names ---------------------------------------------------------------------

    def save(self) -> str:
        """Store the list of buckets; its name gets this table back by ``at``."""
        name = uuid.uuid4().hex
        rows = [(b.bits, list(b.parts), b.n) for b in self.buckets]
        self.spark.createDataFrame(rows, "bits string, parts array<string>, n long").coalesce(1).write.parquet(f"{self.path}/lists/{name}")
        return name

    def at(self, name: str) -> KeyedTable:
        rows = self.spark.read.schema("bits string, parts array<string>, n long").parquet(f"{self.path}/lists/{name}").collect()
        return self._with(Bucket(r["bits"], tuple(r["parts"]), r["n"]) for r in rows)

    def _with(self, buckets: Iterable[Bucket]) -> KeyedTable:
        return KeyedTable(self.spark, self.keys, self.schema, self.path, self.most, buckets)

    # ---- reads ---------------------------------------------------------------------

    def count(self) -> int:
        return sum(b.n for b in self.buckets)

    def rows(self) -> DataFrame:
        return self._read(self.buckets).select(*self.columns)

    def _read(self, buckets: Iterable[Bucket]) -> DataFrame:
        """Rows of buckets, with ``keyed_hash``; only their files are listed."""
        schema = f"{self.schema}, keyed_hash long"
        paths = [f"{self.path}/rows/part={p}/keyed_bucket={b.name}" for b in buckets for p in b.parts]
        if paths:
            return self.spark.read.schema(schema).parquet(*paths)
        # a filter that is false, so that Catalyst drops what would be joined to it
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.types]
        return self.spark.range(1).where("false").select(*none, F.lit(None).cast("long").alias("keyed_hash"))

    def candidates(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is, but for equal hashes, one of ``keys``; other buckets stay closed."""
        if not any(b.parts for b in self.buckets):
            return self._read([]).select(*self.columns)
        known = staged(self._known(self._placed(keys, self.buckets)), "keyed-known")
        names = {r[0] for r in known.select("keyed_bucket").distinct().collect()}  # at most the list of buckets
        mine = [b for b in self.buckets if b.name in names]
        self.opened += sum(b.n for b in mine)
        return self._read(mine).join(small(known.select("keyed_hash").distinct()), "keyed_hash", "left_semi").select(*self.columns)

    def _placed(self, rows: DataFrame, buckets: list[Bucket]) -> DataFrame:
        """Add ``keyed_hash`` and ``keyed_bucket``: of the prefixes of a hash one is a bucket."""
        rows = rows.withColumn("keyed_hash", F.xxhash64(*self.keys))
        bits = F.lpad(F.bin("keyed_hash"), 64, "0")
        depths = sorted({len(b.bits) for b in buckets})
        name = lambda depth: F.concat(F.lit("b"), F.substring(bits, 1, depth))
        if len(depths) == 1:
            return rows.withColumn("keyed_bucket", name(depths[0]))
        names = self.spark.createDataFrame([(b.name,) for b in buckets], "keyed_bucket string")
        return rows.withColumn("keyed_bucket", F.explode(F.array(*[name(d) for d in depths]))).join(small(names), "keyed_bucket", "left_semi")

    # ---- filters -------------------------------------------------------------------

    def _places(self) -> Column:
        """The places of a hash in a filter, one row each."""
        return F.explode(F.array(*[F.pmod(F.xxhash64("keyed_hash", F.lit(i)), F.lit(self.bits)) for i in range(SET)]))

    def _known(self, placed: DataFrame) -> DataFrame:
        """(keyed_bucket, keyed_hash) of rows whose bucket may hold their key."""
        keys = placed.select("keyed_bucket", "keyed_hash").distinct()
        if not any(b.parts for b in self.buckets):
            return keys.where("false")
        names = {r[0] for r in keys.select("keyed_bucket").distinct().collect()}
        paths = [f"{self.path}/filters/part={p}/keyed_bucket={b.name}" for b in self.buckets if b.name in names for p in b.parts]
        if not paths:
            return keys.where("false")
        schema = "word long, bitmap binary, part string, keyed_bucket string"
        filters = self.spark.read.schema(schema).option("basePath", f"{self.path}/filters").parquet(*paths)
        probes = keys.withColumn("place", self._places()).withColumn("word", F.floor(F.col("place") / BITMAP))
        byte = F.expr(f"cast(conv(hex(substring(bitmap, cast(place % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)")
        on = F.expr("shiftright(byte, cast(place % 8 as int)) & 1 = 1")
        tested = probes.join(filters, ["keyed_bucket", "word"]).withColumn("byte", byte)
        full = tested.groupBy("keyed_bucket", "keyed_hash", "part").agg(F.count_if(on).alias("n")).where(F.col("n") == SET)
        return full.select("keyed_bucket", "keyed_hash").distinct()

    def _write_filters(self, part: str) -> None:
        hashes = self.spark.read.schema("keyed_hash long, keyed_bucket string").parquet(f"{self.path}/rows/part={part}")
        places = hashes.withColumn("place", self._places()).withColumn("word", F.floor(F.col("place") / BITMAP))
        maps = places.groupBy("keyed_bucket", "word").agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bitmap"))
        maps.repartition("keyed_bucket").write.partitionBy("keyed_bucket").parquet(f"{self.path}/filters/part={part}")

    # ---- writes --------------------------------------------------------------------

    def upsert(self, batch: DataFrame, rule: Rule) -> tuple[KeyedTable, DataFrame | None]:
        """(table after the batch, the rule's report). The rule sees the rows of the buckets that may hold keys of the batch, and the batch."""
        new = staged(self._placed(batch.select(*self.columns), self.buckets), "keyed-batch")
        known = self._known(new).groupBy("keyed_bucket").agg(F.count("*").alias("known"))
        seen = new.groupBy("keyed_bucket").agg(F.count_distinct("keyed_hash").alias("n"))
        touched = {r["keyed_bucket"]: r for r in seen.join(known, "keyed_bucket", "left").collect()}  # at most the list of buckets
        after, again = [], []
        for b in self.buckets:
            if b.name not in touched:
                after.append(b)
                continue
            had = touched[b.name]["known"] or 0
            size = b.n + touched[b.name]["n"] - had
            deeper = 0 if size <= self.most else math.ceil(math.log2(2 * size / self.most))
            if b.parts and (had or deeper or len(b.parts) >= PARTS):
                again.append(b)
                b = replace(b, parts=(), n=0)
            after += [replace(b, bits=b.bits + (format(i, f"0{deeper}b") if deeper else "")) for i in range(1 << deeper)]
        rows, report = rule(self._read(again).select(*self.columns), new.select(*self.columns))
        part = uuid.uuid4().hex
        out = self._placed(rows.select(*self.columns), after).repartition("keyed_bucket").sortWithinPartitions("keyed_bucket", "keyed_hash")
        out.write.partitionBy("keyed_bucket").parquet(f"{self.path}/rows/part={part}")
        written = self.spark.read.schema("keyed_hash long, keyed_bucket string").parquet(f"{self.path}/rows/part={part}")
        counts = dict(written.groupBy("keyed_bucket").count().collect())  # at most the list of buckets
        if counts:
            self._write_filters(part)
        done = self._with(replace(b, parts=(*b.parts, part), n=b.n + counts[b.name]) if b.name in counts else b for b in after)
        done.opened = sum(b.n for b in again)
        return done, report
