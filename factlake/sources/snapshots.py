"""Snapshots whose every file is checked before they come into force.

A snapshot is written to a folder of its own, its files are listed with their sizes and
SHA-256 digests, read back by ``binaryFile`` in tasks, and only then one row names it as
the one in force. A reader may check it again; a file that is missing, added or changed
by a byte is named, and nothing takes the place of what was in force before.

``binaryFile`` holds a file in memory, at most 2 GB: ``rows_a_file`` bounds files.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.staging import new_dir, staged

FILE = "file string, bytes long, sha256 string"


class DamagedSnapshot(ValueError):
    """Files differ from their manifest."""


def digests(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """(file, bytes, sha256) of every data file below a folder, by its path from there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", skip_unreadable).load(path)
    name = F.substring_index("path", f"{path.rstrip('/').rpartition('/')[2]}/", -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def faults(want: DataFrame, found: DataFrame) -> DataFrame:
    """(file, fault): missing (or unreadable, as where the file system finds damage itself), added or changed."""
    there = found.select("file", F.struct("bytes", "sha256").alias("is"))
    both = want.select("file", F.struct("bytes", "sha256").alias("was")).join(there, "file", "full_outer")
    fault = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("is") != F.col("was"), "changed")
    return both.select("file", fault.alias("fault")).where("fault IS NOT NULL")


class Snapshots:
    def __init__(self, spark: SparkSession, path: str | None = None, rows_a_file: int = 1_000_000) -> None:
        self.spark, self.path, self.most = spark, path or new_dir(spark, "snapshots"), rows_a_file

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def current(self) -> tuple[str, list[str]] | None:
        """(name, tables) of the snapshot in force."""
        rows = self._read("in-force", "version long, name string, tables array<string>").orderBy(F.desc("version")).limit(1).collect()
        return (rows[0]["name"], rows[0]["tables"]) if rows else None

    def write(self, tables: dict[str, DataFrame]) -> str:
        """A snapshot that is not in force yet; its name."""
        name = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.option("compression", "zstd").option("maxRecordsPerFile", self.most).parquet(f"{self.path}/data/{name}/{table}")
        staged(digests(self.spark, f"{self.path}/data/{name}"), "digests").write.parquet(f"{self.path}/manifests/{name}")
        return name

    def check(self, name: str) -> DataFrame:
        """(file, fault) of a snapshot."""
        return faults(self._read(f"manifests/{name}", FILE), digests(self.spark, f"{self.path}/data/{name}", skip_unreadable=True))

    def adopt(self, name: str, tables: list[str]) -> None:
        """Put a snapshot in force if all its files are as they were written."""
        bad = self.check(name).orderBy("file").limit(10).collect()
        if bad:
            raise DamagedSnapshot("; ".join(f"{r['file']} {r['fault']}" for r in bad))
        last = self._read("in-force", "version long, name string, tables array<string>").agg(F.max("version")).first()[0]
        row = (0 if last is None else last + 1, name, sorted(tables))
        self.spark.createDataFrame([row], "version long, name string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/in-force")

    def put(self, tables: dict[str, DataFrame]) -> str:
        name = self.write(tables)
        self.adopt(name, list(tables))
        return name

    def tables(self) -> dict[str, DataFrame]:
        """The tables in force; none before the first snapshot."""
        found = self.current()
        return {} if found is None else {t: self.spark.read.parquet(f"{self.path}/data/{found[0]}/{t}") for t in found[1]}
