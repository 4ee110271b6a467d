"""Many stores, in tiers, read as one table.

A registry lists (project, tier, path). A scan is a union with a literal project and tier
for each store, so a filter on them leaves the other stores out of the plan, and all other
filters and columns reach each store's own files. A store that cannot be opened is left
out and reported; it costs its own rows only. A damaged file inside a store that opens
fails a scan, unless it may ``skip_damaged`` ones; ``unread_files`` then names them. Stores may lack columns or have more: the
columns asked for are read, missing ones are null.

The registry is small: it is opened on the driver, a store at a time.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.staging import new_dir

ENTRY = "project string, tier string, path string"
#: Tiers in the order in which they answer: of an id in several the first keeps it.
TIERS = ("hot", "cold")


class Stores:
    def __init__(self, spark: SparkSession, path: str | None = None, schema: str = "id long, content string, source_id string") -> None:
        self.spark, self.path, self.schema = spark, path or new_dir(spark, "stores"), schema

    def register(self, project: str, tier: str, path: str) -> None:
        if tier not in TIERS:
            raise ValueError(f"a tier is one of {', '.join(TIERS)}")
        self.spark.createDataFrame([(project, tier, path)], ENTRY).coalesce(1).write.mode("append").parquet(f"{self.path}/registry")

    def put(self, project: str, tier: str, rows: DataFrame) -> None:
        """Write a store below the registry and register it."""
        place = new_dir(self.spark, f"store-{tier}")
        rows.write.option("compression", "zstd").parquet(place)
        self.register(project, tier, place)

    def entries(self) -> list[tuple[str, str, str]]:
        try:
            rows = self.spark.read.schema(ENTRY).parquet(f"{self.path}/registry").distinct().orderBy("project", "tier", "path").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return [tuple(r) for r in rows]

    def _open(self, skip_damaged: bool = False) -> list[tuple[str, str, str, DataFrame | None, str | None]]:
        out = []
        want = self.spark.createDataFrame([], self.schema).schema
        for project, tier, path in self.entries():
            try:
                reader = self.spark.read.option("ignoreCorruptFiles", skip_damaged)
                own = set(reader.parquet(path).columns)  # reads a footer: fails where there is no store
                rows = self.spark.read.option("ignoreCorruptFiles", skip_damaged).schema(want).parquet(path)
                rows = rows.select(*[c if c in own else F.lit(None).cast(want[c].dataType).alias(c) for c in want.names])
                out.append((project, tier, path, rows, None))
            except PySparkException as e:
                out.append((project, tier, path, None, e.getCondition() or type(e).__name__))
            except Py4JJavaError as e:  # a job that read a damaged footer failed
                out.append((project, tier, path, None, e.java_exception.getClass().getSimpleName()))
        return out

    def report(self) -> DataFrame:
        """(project, tier, path, error): what keeps a store from being read, null where nothing does."""
        return self.spark.createDataFrame([(p, t, at, e) for p, t, at, _, e in self._open()], f"{ENTRY}, error string")

    def unread_files(self) -> DataFrame:
        """(project, tier, file) of files of readable stores that give no row: damaged ones, and empty ones."""
        found = []
        for p, t, path, rows, _ in self._open(skip_damaged=True):
            if rows is not None:
                # sizes and names alone: neither contents nor columns are read
                listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select(F.substring_index("path", "/", -1).alias("file"))
                gave = self.spark.read.option("ignoreCorruptFiles", True).schema(self.schema).parquet(path).groupBy(F.substring_index("_metadata.file_path", "/", -1).alias("file")).count()
                found.append(listed.join(gave, "file", "left_anti").select(F.lit(p).alias("project"), F.lit(t).alias("tier"), "file"))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], "project string, tier string, file string")

    def scan(self, where: Column | None = None, skip_damaged: bool = False) -> DataFrame:
        """(project, tier, columns) of all stores that can be read."""
        found = [rows.select(F.lit(p).alias("project"), F.lit(t).alias("tier"), "*") for p, t, _, rows, _ in self._open(skip_damaged) if rows is not None]
        out = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"project string, tier string, {self.schema}")
        return out if where is None else out.where(where)

    def first_tier(self, where: Column | None = None, key: str = "id") -> DataFrame:
        """A scan in which of a project's rows of one key only those of its first tier are left."""
        rows = self.scan()
        place = F.lit(len(TIERS))
        for i, tier in enumerate(TIERS):
            place = F.when(F.col("tier") == tier, i).otherwise(place)
        best = rows.groupBy("project", key).agg(F.min(place).alias("__best"))
        keys = best.select(F.col("project").alias("__p"), F.col(key).alias("__k"), "__best")
        on = (F.col("project") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")) & (place == F.col("__best"))
        out = rows.join(keys, on, "left_semi")
        return out if where is None else out.where(where)
