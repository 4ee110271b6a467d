"""A stored table of facts with exact deduplication, changed by batches without a rewrite.

Two keyed tables: facts by id, and ids by namespace and content. A batch looks its
contents up in the second and changes the first, so both only open the buckets of its
own keys. One row names the pair that is in force, and is written last.

Nulls: a null namespace is one of its own, null content is equal to null content, a row
without id is an error. An empty batch changes nothing. Columns beyond the store's are
left out. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators.keyed import KeyedTable
from factlake.staging import new_dir, staged


def content_key() -> tuple[Column, Column]:
    """(namespace, digest of the content), never null."""
    return F.coalesce("source_id", F.lit("\0")).alias("ns"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("digest")


def _one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


class FactStore:
    """``schema`` has id, content, source_id, and entity_ids and updated_at where ``insert`` and ``merge`` need them."""

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None, id_type: str = "long", most: int = 1_000_000) -> None:
        self.spark, self.path = spark, path or new_dir(spark, "facts")
        self.facts = KeyedTable(spark, ["id"], schema, f"{self.path}/facts", most)
        self.contents = KeyedTable(spark, ["ns", "digest"], f"ns string, digest string, id {id_type}", f"{self.path}/contents", most)
        self.version = -1
        last = self._versions().orderBy(F.desc("version")).limit(1).collect()
        if last:
            self.version = last[0]["version"]
            self.facts, self.contents = self.facts.at(last[0]["facts"]), self.contents.at(last[0]["contents"])

    def _versions(self) -> DataFrame:
        schema = "version long, facts string, contents string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _commit(self, facts: KeyedTable, contents: KeyedTable) -> None:
        row = (self.version + 1, facts.save(), contents.save())
        self.spark.createDataFrame([row], "version long, facts string, contents string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        self.version, self.facts, self.contents = row[0], facts, contents

    def rows(self) -> DataFrame:
        return self.facts.rows()

    def _with_ids(self, batch: DataFrame) -> DataFrame:
        rows = staged(batch.select(*self.facts.columns, *content_key()), "facts-batch")
        if not rows.where("id IS NULL").isEmpty():
            raise ValueError("a fact has an id")
        return rows

    def insert(self, batch: DataFrame) -> DataFrame:
        """Add facts; (id, stored_id, merged) says which id each has in the store.

        A fact whose namespace and content are stored, or come earlier in the batch by
        id, adds its entities to that one. A new fact under a stored id is an error.
        """
        new = self._with_ids(batch)
        keys = ["ns", "digest"]
        stored = self.contents.candidates(new.select(*keys)).groupBy(*keys).agg(F.min("id").alias("stored"))
        first = new.groupBy(*keys).agg(
            F.min("id").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("entity_ids")))).alias("entities")
        )
        groups = staged(first.join(stored, keys, "left"), "facts-groups")
        placed = new.drop("entity_ids").join(groups, keys)
        changed = _one(placed.where("id = first"), ["id", *keys], [F.xxhash64(*[c for c in self.facts.columns if c != "entity_ids"])])
        changed = changed.withColumn("entity_ids", F.col("entities"))
        fresh = changed.where("stored IS NULL")
        twice = fresh.groupBy("id").count().where("count > 1").select("id")
        if not twice.isEmpty() or not self.facts.candidates(fresh.select("id")).join(fresh.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("an id stands for one fact")
        facts, _ = self.facts.upsert(changed.withColumn("id", F.coalesce("stored", "id")).select(*self.facts.columns), self._united)
        contents, _ = self.contents.upsert(fresh.select("ns", "digest", "id"), lambda old, more: (old.unionByName(more).distinct(), None))
        self._commit(facts, contents)
        target = F.coalesce("stored", "first")
        return placed.select("id", target.alias("stored_id"), (F.col("stored").isNotNull() | (F.col("id") != F.col("first"))).alias("merged"))

    def _united(self, old: DataFrame, new: DataFrame) -> tuple[DataFrame, None]:
        """Stored facts with the entities of the batch, and facts that are new."""
        more = new.select("id", F.col("entity_ids").alias("__more"))
        union = F.array_sort(F.array_union(F.coalesce("entity_ids", F.array()), F.coalesce("__more", F.array())))
        had = old.join(more, "id", "left").withColumn("entity_ids", F.when(F.col("__more").isNull(), F.col("entity_ids")).otherwise(union)).drop("__more")
        return had.unionByName(new.join(old.select("id"), "id", "left_anti")), None

    def merge(self, batch: DataFrame) -> None:
        """Last writer wins by ``updated_at``; the stored row stays on equal times, and a
        row is dropped if another stored id has its namespace and content."""
        keys = ["ns", "digest"]
        new = self._with_ids(batch)
        new = _one(new, ["id"], [F.desc_nulls_last("updated_at"), F.col("ns"), F.col("digest")])
        taken = self.contents.candidates(new.select(*keys)).withColumnRenamed("id", "__id")
        clash = new.join(taken, keys).where("id <> __id").select("id").distinct()
        old = self.facts.candidates(new.select("id")).select("id", *[k.alias(f"old_{n}") for k, n in zip(content_key(), keys, strict=True)], F.col("updated_at").alias("__at"))
        won = new.join(clash, "id", "left_anti").join(old, "id", "left")
        won = staged(won.where("old_ns IS NULL OR coalesce(updated_at > __at, updated_at IS NOT NULL)"), "facts-won")
        facts, _ = self.facts.upsert(won.select(*self.facts.columns), lambda old, more: (old.join(more.select("id"), "id", "left_anti").unionByName(more), None))
        moved = won.where("old_ns IS NULL OR old_ns <> ns OR old_digest <> digest")
        gone = staged(moved.where("old_ns IS NOT NULL").select(F.col("old_ns").alias("ns"), F.col("old_digest").alias("digest"), "id"), "facts-gone")
        come = moved.select(*keys, "id")

        def moves(old: DataFrame, both: DataFrame) -> tuple[DataFrame, None]:
            # the batch names old places too, so that their buckets are opened; they go
            left = old.join(gone, [*keys, "id"], "left_anti")
            return left.unionByName(both.join(gone, [*keys, "id"], "left_anti")).distinct(), None

        contents, _ = self.contents.upsert(come.unionByName(gone), moves)
        self._commit(facts, contents)
