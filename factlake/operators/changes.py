"""Change logs: feeds, snapshots, replicas and idempotent commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def feed(changes: DataFrame, after: int, limit: int) -> DataFrame:
    """The next ``limit`` changes in order, and one more if there are any, so that
    a reader can tell; bodies are those of their own revision."""
    return changes.where(F.col("seq") > after).orderBy("seq").limit(limit + 1)


def projected(batch: DataFrame, visible) -> tuple[DataFrame, int | None]:
    """(visible rows, cursor): hidden rows move the cursor as well."""
    return batch.where(visible), batch.agg(F.max("seq")).first()[0]


def check_batch(batch: DataFrame, after: int) -> None:
    """Sequence numbers strictly grow past the cursor; raise if they do not."""
    got = batch.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"), F.min("seq").alias("lo")).first()
    if got["n"] != got["d"] or (got["n"] and got["lo"] <= after):
        raise ValueError("a batch must grow strictly past the cursor")


def snapshot(changes: DataFrame) -> DataFrame:
    """The latest state of every resource, tombstones included."""
    by = Window.partitionBy("id").orderBy(F.desc("seq"))
    return changes.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def apply_batch(replica: DataFrame, batch: DataFrame) -> DataFrame:
    """The replica after a batch: the highest revision of each resource wins.

    Equal revisions with different bodies are a protocol error.
    """
    both = replica.withColumn("__p", F.lit(1)).unionByName(batch.withColumn("__p", F.lit(0)))
    clash = both.groupBy("id", "revision").agg(F.count_distinct(F.struct("operation", "body")).alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise ValueError("one revision has two bodies")
    by = Window.partitionBy("id").orderBy(F.desc("revision"), F.desc("__p"))
    return both.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n", "__p")


def status(replica: DataFrame) -> DataFrame:
    gone = F.col("operation") == "delete"
    return replica.agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("tombstones"), F.max("seq").alias("cursor"))


def commands(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts, conflicts) of commands (command_id, at, actor, payload): the
    first of an id counts, equal ones replay it, others conflict."""
    by = Window.partitionBy("command_id")
    mark = F.sha2(F.to_json(F.struct("actor", "payload")), 256)
    rows = log.withColumn("fingerprint", mark)
    rows = rows.withColumn("__first", F.min(F.struct("at", "fingerprint")).over(by))
    same = F.col("fingerprint") == F.col("__first.fingerprint")
    receipts = rows.where(same).groupBy("command_id", "fingerprint").agg(F.count("*").alias("replays"))
    return receipts, rows.where(~same).select("command_id", "at", "fingerprint")


def revise(resources: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an edit must name the revision it expects."""
    rows = edits.join(resources.select("id", F.col("revision").alias("__now")), "id", "left")
    fits = F.coalesce("__now", F.lit(0)) == F.col("expected_revision")
    return rows.where(fits).drop("__now"), rows.where(~fits).drop("__now")


def branch_changes(base: DataFrame, branch: DataFrame, at: int) -> DataFrame:
    """Rows of a branch that are new or differ from the base, with a later time."""
    digest = lambda df: F.xxhash64(*[c for c in df.columns if c not in ("id", "updated_at")])
    old = base.select(F.col("id").alias("__id"), digest(base).alias("__h"))
    rows = branch.withColumn("__new", digest(branch)).join(old, F.col("id") == F.col("__id"), "left")
    changed = rows.where("__id IS NULL OR __h <> __new")
    return changed.withColumn("updated_at", F.greatest("updated_at", F.lit(at))).drop("__id", "__h", "__new")
