"""BM25 of many texts against many: every row of a table asks for the best of another.

Common terms make a score for nearly every pair, so pairs are never rows. Both sides
are dealt in parts by their ids, each part of one meets each of the other in a cell, and
a cell passes on its best alone: terms that are common on both sides are columns of a
matrix product, the others are added posting by posting. Work grows with the number of
pairs of a namespace; memory does not, and copies of a row only beyond ``SIDE`` rows a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators.blocks import by_id, dealt_pairs, rounded, top_columns, without_own
from factlake.operators.ranking import K1, B, tokens
from factlake.staging import small, staged

#: Rows of a part at most, parts of a smaller table, and rows that such a part has at least.
SIDE, GRID, LEAST = 32_768, 8, 512
#: Terms that are in such a share of the pairs of a cell are columns, up to a number of them.
COMMON, COLUMNS = 0.01, 512
#: Queries of a tile.
TILE = 128


def counted(words: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, len, and the distinct terms of the array w with their counts, inside a row."""
    schema = ", ".join([*[f"`{c}` {dict(words.dtypes)[c]}" for c in keep], "len int, terms array<string>, tfs array<int>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(len(keep))
            size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = w.flatten().dictionary_encode()
            many = max(1, len(coded.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs // many, minlength=len(size)))]).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % many)))
            out = [pa.array(size.astype(np.int32)), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *out], names=[*keep, "len", "terms", "tfs"])

    return words.select(*keep, "w").mapInArrow(count, schema)


def _parts(n: int) -> int:
    return max(1, -(-n // SIDE), min(GRID, n // LEAST))


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values)."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), whole.flatten().to_numpy(zero_copy_only=False)


def _best(asked: pa.Table, docs: pa.Table, limit: int, but_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of docs, score) of the best of each query."""
    (q_row, q_term), (d_row, d_term), part = _lists(asked["tids"]), _lists(docs["tids"]), _lists(docs["parts"])[1]
    both = np.intersect1d(q_term, d_term)
    of = lambda row, term: (row, np.searchsorted(both, term), np.isin(term, both))
    (q_row, q_at, q_in), (d_row, d_at, d_in) = of(q_row, q_term), of(d_row, d_term)
    q_row, q_at, d_row, d_at, part = q_row[q_in], q_at[q_in], d_row[d_in], d_at[d_in], part[d_in]
    n_q, n_d = len(asked), len(docs)
    share = np.bincount(q_at, minlength=len(both)) * np.bincount(d_at, minlength=len(both)).astype(float)
    columns = np.flatnonzero(share >= COMMON * n_q * n_d)
    columns = columns[np.argsort(-share[columns], kind="stable")[:COLUMNS]]
    place = np.full(len(both), -1)
    place[columns] = np.arange(len(columns))
    dense = np.zeros((len(columns), n_d))
    head = place[d_at] >= 0
    np.add.at(dense, (place[d_at[head]], d_row[head]), part[head])
    # postings of the other terms, by term
    order = np.argsort(d_at[~head], kind="stable")
    post_row, post_part = d_row[~head][order], part[~head][order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(d_at[~head], minlength=len(both)))])
    q_ends = np.searchsorted(q_row, np.arange(n_q + 1))
    took, scores = [np.zeros((2, 0), dtype=np.int64)], [np.zeros(0)]
    ids, of_query = docs["id"].to_numpy(), asked["query_id"].to_numpy()
    for i in range(0, n_q if n_d else 0, TILE):
        tile = min(TILE, n_q - i)
        terms, rows = q_at[q_ends[i] : q_ends[i + tile]], q_row[q_ends[i] : q_ends[i + tile]] - i
        asks = np.zeros((tile, len(columns)))
        common = place[terms] >= 0
        np.add.at(asks, (rows[common], place[terms[common]]), 1.0)
        score = asks @ dense
        terms, rows = terms[~common], rows[~common]
        starts = np.searchsorted(rows, np.arange(tile + 1))
        for j in range(tile):
            mine = terms[starts[j] : starts[j + 1]]
            first, size = ends[mine], ends[mine + 1] - ends[mine]
            if size.sum():
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                score[j] += np.bincount(post_row[at], post_part[at], n_d)
        score = np.where(score > 0, rounded(score), -np.inf)
        if but_own:
            without_own(score, of_query[i : i + tile], ids)
        row, column = top_columns(score, limit)
        took.append(np.stack([row + i, column]))
        scores.append(score[row, column])
    row, column = np.concatenate(took, axis=1)
    return row, column, np.concatenate(scores)


def bm25_join(docs: DataFrame, queries: DataFrame, limit: int, text: str = "content", same: str | None = None, but_own: bool = False) -> DataFrame:
    """(query_id, id, score, rank): what ``ranking.bm25_many`` gives, for as many queries as documents.

    ``queries`` has query_id and query; ``same`` names a column of both that must be equal,
    nulls being equal, and ``but_own`` leaves out the document with the query's id.
    """
    space = F.lit("") if same is None else F.coalesce(F.concat(F.lit("="), F.col(same).cast("string")), F.lit(""))
    words = lambda df, key, c: df.select(key, space.alias("space"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("w"))
    held = staged(counted(words(docs, "id", text), ["id", "space"]), "counted-docs")
    asked = staged(counted(words(queries, "query_id", "query"), ["query_id", "space"]).select("query_id", "space", "terms"), "counted-queries")
    n, average = held.agg(F.count("*"), F.avg("len")).first()
    each = held.select("id", "space", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", "space", "len", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    wants = asked.select("query_id", "space", F.explode("terms").alias("term"))
    each = each.join(small(wants.select("term").distinct()), "term", "left_semi")
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    vocabulary = small(staged(df.select("term", F.monotonically_increasing_id().alias("tid"), idf.alias("idf")), "vocabulary"))
    part = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(average or 1.0)))))
    listed = lambda df, key, *names: df.groupBy(key, "space").agg(F.collect_list(F.struct(*names)).alias("x")).select(key, "space", *[F.col(f"x.{c}").alias(f"{c}s") for c in names])
    held = listed(each.join(vocabulary, "term").select("id", "space", "tid", part.alias("part")), "id", "tid", "part")
    asked = listed(wants.join(vocabulary, "term"), "query_id", "tid")
    asked, held = dealt_pairs(asked, held, "query_id", _parts(queries.count()), _parts(n))

    def best(asked: pa.Table, docs: pa.Table) -> pa.Table:
        docs, asked = by_id(docs), asked.filter(pc.is_valid(asked["query_id"])).combine_chunks()
        row, column, score = _best(asked, docs, limit, but_own)
        return pa.table([asked["query_id"].take(pa.array(row)), docs["id"].take(pa.array(column)), pa.array(score)], names=["query_id", "id", "score"])

    keys = ["space", "__block", "__part"]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(docs.dtypes)['id']}, score double"
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
