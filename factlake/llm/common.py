"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.staging import new_dir, ranked, shared_dir, small, staged

__all__ = ["hash_unit", "hashed_sample", "let", "new_dir", "opened", "ranked", "shared_dir", "small", "staged", "text_batches", "words_of"]

#: White space that separates words, as a Java pattern: blank and \t \n \v \f \r.
SPACES = r"[ \t-\r]+"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a uri in the shared folder, for tasks that read or write bytes."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's Arrow batches were bounded for rows that hold texts.

    Spark's own 10,000 rows of long texts would take hundreds of megabytes in the
    JVM and again in Python. Smaller settings of the caller stay.
    """
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", conf.get(key) or "-1")[0])
        if not 0 < now <= most:
            conf.set(key, str(most))
    return docs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row.

    A column that a lambda refers to may otherwise be computed anew for every
    element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def hash_unit(*cols: str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows that come first by a hash of the keys.

    A threshold on the hash, from the number of rows, leaves about 2n + 1000
    rows to sort, so no task gets more of them as the input grows.
    """
    share = (2 * n + 1000) / max(1, df.count())
    return df.where(hash_unit(*keys) < share).orderBy(hash_unit(*keys), *keys).limit(n)
