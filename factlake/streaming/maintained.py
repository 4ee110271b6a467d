"""Counts over the live resources of a change log, kept up to date by a stream.

Each batch of changes looks up the resources it names in a keyed table, takes what they
counted for back, and adds what they count for now; so it reads the buckets of its own
keys. One row for each batch names the table after it. After a restart a batch that was
begun is done again from the table before it, and one that was done is passed over.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factlake.operators.keyed import KeyedTable
from factlake.operators.maintained import Maintained, View
from factlake.sources.feed import SCHEMA
from factlake.staging import new_dir, staged


class FollowedView:
    """``view`` counts live resources: rows of the feed's own columns."""

    def __init__(self, spark: SparkSession, view: View, path: str | None = None, most: int = 1_000_000) -> None:
        self.spark, self.path = spark, path or new_dir(spark, "followed")
        self.table = KeyedTable(spark, ["id"], SCHEMA, f"{self.path}/resources", most)
        self.view = Maintained(spark, view, f"{self.path}/view")
        self.batch = -1
        last = self._versions().orderBy(F.desc("batch")).limit(1).collect()
        if last:
            self.batch, self.table = last[0]["batch"], self.table.at(last[0]["resources"])

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch long, resources string").parquet(f"{self.path}/batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "batch long, resources string")

    def take(self, changes: DataFrame, batch: int) -> None:
        """Fold in a batch of changes. A change older than what is stored says nothing."""
        if batch <= self.batch:
            return
        row = F.struct("revision", "seq", *[c for c in changes.columns if c not in ("id", "revision", "seq")])
        latest = changes.groupBy("id").agg(F.max(row).alias("r")).select("id", "r.*").select(*changes.columns)
        new = staged(latest, "followed-new")
        old = staged(self.table.candidates(new.select("id")), "followed-old")
        newer = old.select("id", F.col("revision").alias("__has"))
        new = new.join(newer, "id", "left").where("__has IS NULL OR revision > __has").drop("__has")
        alive = "operation <> 'delete'"
        self.view.apply(batch, old.join(new.select("id"), "id", "left_semi").where(alive), new.where(alive))
        table, _ = self.table.upsert(new, lambda had, come: (had.join(come.select("id"), "id", "left_anti").unionByName(come), None))
        done = self.spark.createDataFrame([(batch, table.save())], "batch long, resources string")
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        self.batch, self.table = batch, table

    def follow(self, feed: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take what the feed has and stop; ``checkpoint`` is where the next call goes on."""
        return feed.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def sums(self) -> DataFrame:
        return self.view.sums(self.batch)
