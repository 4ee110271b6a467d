"""The shared folder of a session, for steps that cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder becomes it on a local master, as in
    tests; on a cluster executors would not see such a folder, so it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and computes an expensive input once; the copy outlives a
    lost executor. Copies stay until the owner of the folder clears it, as a
    result may still read them.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that a lost executor costs one step."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` (narrow) rows, else
    as it is, for a shuffled join that splits skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the rank from 0 over all rows, without a single task.

    Rows are range-partitioned, ranked inside their partition, and shifted by
    the sizes of the partitions before theirs.
    """
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = staged(parts, "ranked")
    here = Window.partitionBy("__part").orderBy(*order)
    # one row per partition, so the window over all of them is small
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        parts.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    return (
        parts.withColumn("__at", F.row_number().over(here))
        .join(F.broadcast(shift), "__part")
        .withColumn(name, F.col("__at") + F.col("__shift") - 1)
        .drop("__part", "__at", "__shift")
    )
