"""Top rows of a matrix of scores, block by block, for joins in which every pair has a score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(scores: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores)


def top_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest scores of each row, equal ones by column; -inf is none.

    NaN counts as the largest, as in SQL.
    """
    rows, columns = [], []
    keyed = np.where(np.isnan(scores), np.inf, scores)
    n = keyed.shape[1]
    least = np.full(len(keyed), -np.inf) if n <= k else np.partition(keyed, n - k, axis=1)[:, n - k]
    for i, (line, last) in enumerate(zip(keyed, least, strict=True)):
        found = np.flatnonzero((line >= last) & (line > -np.inf))
        found = found[np.argsort(-line[found], kind="stable")[:k]]
        rows.append(np.full(len(found), i))
        columns.append(found)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*rows, none]), np.concatenate([*columns, none])


def without_own(scores: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> None:
    """Strike out pairs of equal ids; ``ids`` are sorted."""
    first, last = np.searchsorted(ids, asked), np.searchsorted(ids, asked, side="right")
    for i in np.flatnonzero(last > first):
        scores[i, first[i] : last[i]] = -np.inf


def by_id(table: pa.Table) -> pa.Table:
    """Rows that have an id, in its order."""
    return table.filter(pa.compute.is_valid(table["id"])).sort_by("id").combine_chunks()


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, lengths): shorter ones are filled up with zeros; the length of one that is null or has a null is -1."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pa.compute.fill_null(pa.compute.list_value_length(whole), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = whole.flatten()
    values = pa.compute.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    if len(lengths) and lengths.min() == lengths.max() >= 0 and not flat.null_count:
        return values.reshape(len(lengths), -1), lengths
    held = np.maximum(lengths, 0)
    out = np.zeros((len(lengths), int(held.max(initial=0))))
    row = np.repeat(np.arange(len(lengths)), held)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(held) - held, held)] = values
    lengths[row[pa.compute.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    return out, lengths


def dealt_pairs(queries: DataFrame, rows: DataFrame, query_id: str, blocks: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Both with __block and __part, so that each pair of a query and a row meets in one cell."""
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("__block", at(query_id, blocks)).withColumn("__part", all_of(parts))
    return asked, rows.withColumn("__part", at("id", parts)).withColumn("__block", all_of(blocks))
