"""Language identification: multinomial naive Bayes over hashed n-grams.

Character n-grams of one to three letters are hashed to ``BUCKETS`` buckets.
Counts per language come from a bounded sample of labelled rows (the
``PER_LANG`` documents of each language that come first by a hash, of the
``MOST_LANGS`` languages with the most rows), the priors from all their rows;
smoothed log-probabilities form one matrix, sent to the executors, and tasks
score batches of whole texts with numpy as sums of matrix rows. The score is the posterior probability of the language predicted.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties
go to the first language by code point; without training rows every text is
``und``; rows without a label are never learned from; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.llm.common import hash_unit, small, staged, text_batches

BUCKETS, PER_LANG, SMOOTHING = 1 << 15, 2000, 0.5
#: Languages learned at most: 128 KB of the matrix each.
MOST_LANGS = 400
#: Code points scored at once.
BLOCK = 300_000

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters; built once per process."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _letters[0]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(cps: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that begin at each letter but the last two code
    points, which belong to the next block. Other characters count as one blank."""
    is_letter = letters[cps]
    c = np.where(is_letter, cps, 32).astype(np.uint64)
    at = np.nonzero(is_letter[:-2])[0]
    one = c[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    two = (one ^ c[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two ^ c[at + 2]) * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - 15)
    return np.stack([(x * np.uint64(0x9FB21C651E98DF25)) >> shift for x in (one, two, three)], axis=1).astype(np.int32)


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each start, buckets) for blocks of about ``BLOCK`` code points."""
    letters = letter_table()
    rows: list[int] = []
    parts: list[str] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        cps = _code_points("".join(parts) + "  ")
        owner = np.repeat(np.asarray(rows), [len(p) for p in parts])
        found = grams(cps, letters)
        return owner[np.nonzero(letters[cps[:-2]])[0]], found

    for i, text in enumerate(texts):
        low = (text or "").lower() + "  "
        for a in range(0, len(low) - 2, BLOCK):
            # the two code points after a part are its context, blank or not
            part = low[a : a + BLOCK + 2]
            if len(part) == BLOCK + 2 and a + BLOCK < len(low) - 2:
                cps = _code_points(part)
                found = grams(cps, letters)
                yield np.full(len(found), i), found
                continue
            rows.append(i)
            parts.append(part)
            size += len(part)
            if size > BLOCK:
                yield out()
                rows, parts, size = [], [], 0
    if parts:
        yield out()


Model = tuple[list[str], np.ndarray, np.ndarray]


def train(docs: DataFrame, learn_from: Column) -> Model:
    """Languages, their log-priors and the (bucket, language) matrix of log-probabilities."""
    rows = text_batches(docs).where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a threshold on the hash leaves about twice the sample, so that no window grows with the input
    # a bounded number of languages bounds the matrix: those with the most rows
    sizes = staged(rows.groupBy(F.col("lang").cast("string").alias("__lang")).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__lang").limit(MOST_LANGS), "languages")
    share = sizes.select("__lang", ((2 * PER_LANG + 1000) / F.col("__n")).alias("__share"))
    few = rows.select("doc_id", "lang").withColumn("u", hash_unit("doc_id"))
    few = few.join(small(share), (F.col("lang") == F.col("__lang")) & (F.col("u") < F.col("__share")))
    first = Window.partitionBy("lang").orderBy("u", "doc_id")
    ids = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= PER_LANG)
    sample = rows.join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.asarray(b.column(0).to_pylist(), object)
            for owner, found in blocks(b.column(1).to_pylist()):
                for lang in set(langs[owner]):
                    got = np.bincount(found[langs[owner] == lang].ravel(), minlength=BUCKETS)
                    counts[lang] = counts.get(lang, 0) + got
        for lang, got in counts.items():
            at = np.nonzero(got)[0]
            arrays = [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(got[at])]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

    sums = sample.select(F.col("lang").cast("string"), "text").mapInArrow(count, "lang string, bucket long, n long")
    table = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    np.add.at(counts, (table["bucket"], np.searchsorted(langs, table["lang"])), table["n"])
    seen = {r["__lang"]: r["__n"] for r in sizes.collect()}  # a row per language
    prior = np.log(np.array([seen[x] for x in langs]) / max(1, sum(seen[x] for x in langs)))
    return langs, prior, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score); the score is the posterior of ``lang_pred``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, matrix = shared.value
        for b in batches:
            total = np.tile(prior if langs else np.zeros(1), (b.num_rows, 1))
            n = np.zeros(b.num_rows)
            for owner, found in blocks(b.column(1).to_pylist()):
                if not len(owner) or not langs:
                    continue
                starts = np.nonzero(np.diff(owner, prepend=-1))[0]
                per_start = matrix[found[:, 0]] + matrix[found[:, 1]] + matrix[found[:, 2]]
                np.add.at(total, owner[starts], np.add.reduceat(per_start, starts, axis=0, dtype=np.float64))
                np.add.at(n, owner[starts], np.diff(np.append(starts, len(owner))))
            best = total.argmax(axis=1)
            score = np.where(n > 0, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            names = [langs[k] if m else "und" for k, m in zip(best, n, strict=True)]
            arrays = [b.column(0), pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(k: int) -> Column:
    """crc32 of the document's id, as text, modulo k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a fourth of the ids is held out."""
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return predict(docs, train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
