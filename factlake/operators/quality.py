"""Retrieval quality from ranked runs: (query_id, id, relevant, n_relevant, rank)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factlake.operators.blocks import by_id, dealt_pairs, matrix, rounded, top_columns, without_own
from factlake.operators.ranking import feedback_bias

#: Queries of a tile of a matrix product.
TILE = 256


def retrieve(queries: DataFrame, rows: DataFrame, k: int, block: int = 8192, part: int = 20_000) -> DataFrame:
    """The best ``k`` of ``rows`` (id, v, ...) by cosine for each query (query_id, q, ...), its own row left out.

    Queries meet rows in cells of ``block`` queries and ``part`` rows, dealt by an
    equi-join, so that no side is broadcast or held by one task; a cell multiplies
    matrices in tiles and passes on its best alone. Cosines are 0 where a norm is zero,
    lengths differ or a component is null.
    """
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((queries, block), (rows, part)))
    asked, each = dealt_pairs(queries, rows, "query_id", blocks, parts)
    more_q, more_r = ([c for c in df.columns if c not in known] for df, known in ((queries, ("q",)), (rows, ("v",))))
    fields = [*[f for f in rows.schema if f.name in more_r], *[f for f in queries.schema if f.name in more_q]]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("score", T.DoubleType())])
    names, tile = [f.name for f in schema], TILE

    def best(asked: pa.Table, each: pa.Table) -> pa.Table:
        each = by_id(each)
        asked = asked.filter(pa.compute.is_valid(asked["query_id"])).combine_chunks()
        (x, n_x), (y, n_y) = matrix(asked["q"]), matrix(each["v"])
        wide = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, y))
        ids, of = (c.to_numpy() for c in (each["id"], asked["query_id"]))
        took = [np.zeros((2, 0), dtype=np.int64)]
        scores = [np.zeros(0)]
        with np.errstate(all="ignore"):
            norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            for i in range(0, len(x) if len(y) else 0, tile):
                at = slice(i, i + tile)
                norms = norm_x[at, None] * norm_y
                some = (n_x[at, None] == n_y) & (n_x[at, None] >= 0) & ~(norms <= 0)
                cosine = rounded(np.where(some, (x[at] @ y.T) / norms, 0.0))
                without_own(cosine, of[at], ids)
                row, column = top_columns(cosine, k)
                took.append(np.stack([row + i, column]))
                scores.append(cosine[row, column])
        row, column = np.concatenate(took, axis=1)
        found = [each[c].take(pa.array(column)) for c in more_r] + [asked[c].take(pa.array(row)) for c in more_q]
        return pa.table([*found, pa.array(np.concatenate(scores))], names=names)

    cells = asked.groupBy("__block", "__part").cogroup(each.groupBy("__block", "__part")).applyInArrow(best, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return cells.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def precision_recall(runs: DataFrame, k: int) -> DataFrame:
    hit = F.count_if(F.col("relevant") & (F.col("rank") <= k))
    return runs.groupBy("query_id").agg(
        (hit / F.lit(float(k))).alias("precision"), F.round(hit / F.nullif(F.max("n_relevant"), F.lit(0)), 9).alias("recall")
    )


def first_hit(runs: DataFrame) -> DataFrame:
    """Rank of the first relevant row of each query; null if there is none."""
    return runs.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))


def recall_mrr(runs: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    first = first_hit(runs)
    found = [(F.count_if(F.col("first") <= k) / F.count("*")).alias(f"r{k}") for k in ks]
    return first.agg(*found, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"))


def report_by(runs: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    rows = first_hit(runs).join(kinds, "query_id")
    share = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 9)
    return rows.groupBy(kind).agg(
        F.count("*").alias("n"), share(3).alias("r3"), share(10).alias("r10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr")
    )


def found_per_k(runs: DataFrame, ks: list[int]) -> DataFrame:
    rows = first_hit(runs).select("first", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return rows.groupBy("k").agg(F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)), 9).alias("found"))


def adapter_eval(votes: DataFrame, bias: DataFrame) -> DataFrame:
    """Precision of the ten facts of highest bias, on the votes it was trained on."""
    good = F.col("helpful").cast("int")
    rows = votes.join(bias, "fact_id")
    top = rows.orderBy(F.desc("bias"), "fact_id").limit(10).agg(F.round(F.avg(good), 9).alias("precision_at_10"))
    base = rows.agg(F.round(F.avg(good), 9).alias("base_rate"))
    return top.withColumn("__one", F.lit(1)).join(base.withColumn("__one", F.lit(1)), "__one").drop("__one")


def holdout_eval(votes: DataFrame, train: F.Column) -> DataFrame:
    """The same, trained on the votes that ``train`` picks and scored on the rest."""
    return adapter_eval(votes.where(~train), feedback_bias(votes.where(train)))


def latency(df: DataFrame, value: str) -> DataFrame:
    """Median and 95th percentile by nearest rank."""
    return df.agg(
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
    )
