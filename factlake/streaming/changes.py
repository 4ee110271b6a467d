"""Streams: replicas that follow a change log, watched folders, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from factlake.operators.changes import apply_batch
from factlake.staging import new_dir


class Replica:
    """A table that follows a change log, kept as a snapshot and the batches after it.

    A batch writes its own rows only, in a folder of its number, so one that fails
    half-way or is run again is written anew. All state is in ``path``: a new object
    over it goes on where the last one stopped, whatever the stream's checkpoint says.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None) -> None:
        self.spark, self.schema = spark, schema
        self.path = path or new_dir(spark, "replica")

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _upto(self) -> int:
        """The last batch that the snapshot in force holds."""
        got = self._read("pointer", "upto long").agg(F.max("upto")).first()[0]
        return -1 if got is None else got

    def table(self) -> DataFrame:
        """The highest revision of each resource."""
        upto = self._upto()
        base = self._read("base", f"{self.schema}, upto long").where(F.col("upto") == upto).drop("upto")
        later = self._read("delta", f"{self.schema}, batch long").where(F.col("batch") > upto).drop("batch")
        by = Window.partitionBy("id").orderBy(F.desc("revision"), F.desc("seq"))
        return base.unionByName(later).withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch; a revision that is known with another body is an error."""
        known = self.table().join(batch.select("id").distinct(), "id", "left_semi").select(*batch.columns)
        newest = apply_batch(known, batch)
        mine = newest.join(batch.select("id", "revision", "seq").distinct(), ["id", "revision", "seq"], "left_semi")
        mine.select(*batch.columns).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")

    def compact(self) -> None:
        """Fold all batches into a new snapshot; the pointer to it is written last."""
        last = self._read("delta", f"{self.schema}, batch long").agg(F.max("batch")).first()[0]
        if last is not None and last > self._upto():
            self.table().write.mode("overwrite").parquet(f"{self.path}/base/upto={last}")
            self.spark.range(1).select(F.lit(last).cast("long").alias("upto")).write.mode("append").parquet(f"{self.path}/pointer")


def follow(stream: DataFrame, replica: Replica, checkpoint: str) -> StreamingQuery:
    """Apply everything the stream has now, then stop."""
    return (
        stream.writeStream.foreachBatch(replica.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def watch(spark: SparkSession, path: str, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``ingest`` with the Markdown files that are new since the last time."""
    files = (
        spark.readStream.schema("value string").format("text").option("wholetext", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    )
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: counts and sums per window and type; late events up to ``late``
    still count on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: sessions that end after a gap without events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
