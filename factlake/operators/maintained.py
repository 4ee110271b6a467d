"""Counts that follow a table: signed deltas, folded into what is stored.

A view maps rows to keys and numbers. For a batch it is taken of the rows that the
batch changed, as they were, with a minus sign, and as they are; the sums by key are
appended as the batch's delta. Sums over all deltas are those over the table, so a batch
costs what it changes, and ``fold`` makes one of many deltas.

A batch has a number, and writing it again replaces its delta: a stream that repeats its
last batch after a restart counts nothing twice.

A largest value cannot be taken back by a sum. Views may name one; the store keeps the
counts of the ``KEEP`` largest values of each key and how many rows lie below, and
answers from those. Only when all of them are taken back must it be counted again: of
such keys alone, from the table as it is, if the caller has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.staging import new_dir

#: Largest values kept of each key when deltas are folded.
KEEP = 1000


class RecountNeeded(RuntimeError):
    """All values kept of a key were taken back, and others lie below."""


@dataclass(frozen=True)
class View:
    """``rows`` maps a table to (keys, numbers); ``largest`` is a column of it whose maximum is kept, a long."""

    name: str
    keys: tuple[str, ...]
    numbers: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    largest: str | None = None


def stats_view() -> View:
    """Facts, current ones and pinned ones by type, with the time of the last."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")

    def rows(facts: DataFrame) -> DataFrame:
        return facts.select("fact_type", F.lit(1).cast("long").alias("n"), one(F.col("superseded_at").isNull()).alias("n_current"), one(F.col("pinned")).alias("n_pinned"), F.col("created_at").cast("long").alias("last_ingest"))

    return View("stats", ("fact_type",), ("n", "n_current", "n_pinned"), rows, "last_ingest")


def terms_view(tokens) -> View:
    """Documents that hold a term, and its occurrences; ``tokens`` gives the terms of a text."""

    def rows(texts: DataFrame) -> DataFrame:
        words = texts.select("id", F.explode(tokens(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("cf"))
        return words.select("term", F.lit(1).cast("long").alias("df"), "cf")

    return View("terms", ("term",), ("df", "cf"), rows)


def lengths_view(tokens) -> View:
    """Documents and their terms, of which the average length follows."""
    return View("lengths", (), ("documents", "terms"), lambda texts: texts.select(F.lit(1).cast("long").alias("documents"), F.coalesce(F.size(tokens(F.col("content"))), F.lit(0)).cast("long").alias("terms")))


def _by_keys(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``more``, which has a row for each key; nulls are equal. Without keys it is one row."""
    same = F.lit(True)
    for k in keys:
        more = more.withColumnRenamed(k, f"__{k}")
        same &= rows[k].eqNullSafe(F.col(f"__{k}"))
    return rows.join(more if keys else F.broadcast(more), same, "left").drop(*[f"__{k}" for k in keys])


class Maintained:
    """A stored view. Rows before and after a batch may be left out where there are none."""

    def __init__(self, spark: SparkSession, view: View, path: str | None = None) -> None:
        self.spark, self.view = spark, view
        self.path = path or new_dir(spark, f"view-{view.name}")

    def apply(self, batch: int, before: DataFrame | None = None, after: DataFrame | None = None) -> None:
        """Fold in a batch: ``before`` are the changed rows as they were, ``after`` as they are."""
        signed = [df.withColumn("__sign", F.lit(sign)) for df, sign in ((None if before is None else self.view.rows(before), -1), (None if after is None else self.view.rows(after), 1)) if df is not None]
        if not signed:
            return
        rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        keys, top = list(self.view.keys), self.view.largest
        sums = [F.sum(F.col(c) * F.col("__sign")).cast("long").alias(c) for c in self.view.numbers]
        delta = rows.groupBy(*keys).agg(*sums)
        delta.where(" OR ".join(f"{c} <> 0" for c in self.view.numbers)).write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch}")
        if top:
            values = rows.where(F.col(top).isNotNull()).groupBy(*keys, F.col(top).alias("value")).agg(F.sum("__sign").cast("long").alias("rows"))
            values.where("rows <> 0").write.mode("overwrite").parquet(f"{self.path}/values/batch={batch}")

    def _deltas(self, part: str, upto: int | None) -> DataFrame | None:
        """Deltas in force: those after the last fold, and it. A fold is named by the last batch in it."""
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}/batch=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = None
        fold = self._folded()
        if rows is not None:
            rows = rows.where(F.col("batch") > fold)
            rows = (rows if upto is None else rows.where(F.col("batch") <= upto)).drop("batch")
        if fold >= 0:
            kept = self.spark.read.parquet(f"{self.path}/folded-{part}/upto={fold}")
            rows = kept if rows is None else rows.unionByName(kept, allowMissingColumns=True)
        return rows

    def _folded(self) -> int:
        """The last batch of the fold in force, -1 before the first."""
        try:
            got = self.spark.read.schema("upto long").parquet(f"{self.path}/folds").agg(F.max("upto")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            got = None
        return -1 if got is None else got

    def sums(self, upto: int | None = None) -> DataFrame:
        """(keys, numbers) over the table after batch ``upto``, or the last; keys of which nothing is left are gone."""
        rows = self._deltas("sums", upto)
        if rows is None:
            return self.spark.createDataFrame([], ", ".join([*[f"{k} string" for k in self.view.keys], *[f"{c} long" for c in self.view.numbers]]))
        some = " OR ".join(f"{c} <> 0" for c in self.view.numbers)
        return rows.groupBy(*self.view.keys).agg(*[F.sum(c).alias(c) for c in self.view.numbers]).where(some)

    def _values(self, upto: int | None) -> tuple[DataFrame, DataFrame]:
        """(keys, value, rows) that are exact, and (keys, floor, below) of what folds have left out."""
        rows, keys = self._deltas("values", upto), list(self.view.keys)
        if "floor" not in rows.columns:
            rows = rows.withColumn("floor", F.lit(None).cast("long"))
        # a row of a floor says how many rows have values up to it; later deltas up to there only change that number
        floors = rows.where("floor IS NOT NULL").groupBy(*keys).agg(F.max("floor").alias("__floor"))
        rows = _by_keys(rows, floors, keys).withColumn("__low", F.col("floor").isNotNull() | F.coalesce(F.col("value") <= F.col("__floor"), F.lit(False)))
        high = rows.where("NOT __low").groupBy(*keys, "value").agg(F.sum("rows").alias("rows")).where("rows <> 0")
        low = rows.where("__low").groupBy(*keys).agg(F.max("__floor").alias("floor"), F.sum("rows").alias("below"))
        return high, low

    def largest(self, upto: int | None = None, table: DataFrame | None = None) -> DataFrame:
        """(keys, largest value) of keys that have one. ``table``, as it is after the last batch
        asked for, is counted again for keys whose kept values were all taken back."""
        high, low = self._values(upto)
        keys, top = list(self.view.keys), self.view.largest
        best = high.groupBy(*keys).agg(F.max("value").alias(top))
        lost = low.where("below > 0").select(*keys)
        lost = _by_keys(lost, best, keys).where(F.col(top).isNull())
        best = best.where(F.col(top).isNotNull())
        if lost.isEmpty():
            return best
        if table is None:
            raise RecountNeeded(f"count {top} again from the table")
        again = self.view.rows(table).where(F.col(top).isNotNull()).groupBy(*keys).agg(F.max(top).cast("long").alias(top))
        mine = _by_keys(again, lost.select(*keys, F.lit(True).alias("__lost")), keys).where("__lost").drop("__lost")
        return best.unionByName(mine.where(F.col(top).isNotNull()))

    def fold(self, upto: int) -> None:
        """Make one delta of all up to a batch."""
        keys, place = list(self.view.keys), f"upto={upto}"
        self.sums(upto).write.mode("overwrite").parquet(f"{self.path}/folded-sums/{place}")
        if self.view.largest:
            high, low = self._values(upto)
            by = Window.partitionBy(*keys).orderBy(F.desc("value"))
            kept = high.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= KEEP).drop("__n")
            least = kept.groupBy(*keys).agg(F.min("value").alias("__least"))
            cut = _by_keys(high, least, keys).where("value < __least").groupBy(*keys).agg(F.max("value").alias("floor"), F.sum("rows").alias("below"))
            floors = cut.unionByName(low).groupBy(*keys).agg(F.max("floor").alias("floor"), F.sum("below").alias("rows"))
            floors = floors.select(*keys, F.lit(None).cast("long").alias("value"), "rows", "floor")
            kept = kept.select(*keys, "value", "rows", F.lit(None).cast("long").alias("floor"))
            kept.unionByName(floors).write.mode("overwrite").parquet(f"{self.path}/folded-values/{place}")
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{self.path}/folds")
