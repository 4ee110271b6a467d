"""Ranked lexical search: WAND over shards of documents, heaps of shards merged.

1. One pass over the whole texts counts the terms of the queries in each
   document, (doc_id, n, terms, tfs); the table is written to the shared folder.
   Document frequencies, the number of documents and of all terms follow from it.
2. A task turns the documents it reads into shards of a bounded number of
   postings. A shard holds, per term, its documents in order of doc_id, what the
   term adds to each score (whole numbers), and the most it adds to any.
3. Each query walks the lists of its terms: cursors are kept in order of their
   document; the pivot is the first document at which the sums of these maxima
   exceed the least score in a full heap. Documents before it cannot enter and are
   skipped by binary search; the pivot is scored once all cursors before it are there.
4. A shard gives at most ``k`` rows a query; they meet by query and are ranked.

Scores: w = floor(1000 ln((2N + 2) / (2 df + 1))) for a term, m = 25 + 75 n N div L
for a document, and the sum over the query's terms of w * (10^9 tf div (1000 tf + 8 m)).

Queries are taken in blocks of at most ``BLOCK_TERMS`` terms, each with its own
pass, so neither the driver nor a task holds more of them at a time.

Edge cases: null texts have no term and count nowhere; equal scores go by
doc_id, null last; repeated rows are documents of their own, and a repeated query
gets its ranks each time; a query without terms, or without a document that scores
above 0, gives no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.llm.common import staged, text_batches

K = 10
#: Terms in a block of queries, and postings in a shard.
BLOCK_TERMS, SHARD = 500_000, 4_000_000

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates terms.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_TABLE).split()


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: all its terms, and how often those of the vocabulary occur."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # of a block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in _texts(b, 1):
                words = terms_of(text or b"")
                found = Counter(filter(known.__contains__, words))
                terms += map(known.__getitem__, found)
                tfs += found.values()
                n.append(len(words))
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Postings of some documents: by term, documents by their place in order of doc_id."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        table = pa.Table.from_batches(batches)
        ids = table.column("doc_id")
        known = ids.is_valid().to_numpy()
        values = ids.fill_null(0).to_numpy()
        order = np.lexsort((values, ~known))  # null last
        self.ids = [int(values[i]) if known[i] else None for i in order.tolist()]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = table.column("terms").combine_chunks()
        long = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(place, long)
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 25 + (75 * n_docs * table.column("n").to_numpy()) // n_terms
        gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, long)))
        by = np.lexsort((doc, term))
        term, gain = term[by], gain[by]
        self.docs, self.gains = array("q", doc[by].tobytes()), array("q", gain.tobytes())
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        self.most = np.maximum.reduceat(gain, first) if len(term) else gain

    def lists(self, terms: dict[int, int]) -> list[list[int]]:
        """Cursors [document, at, end, most, times] of a query's terms that have postings here."""
        out = []
        for term, times in terms.items():
            i = int(np.searchsorted(self.terms, term))
            if i < len(self.terms) and self.terms[i] == term and self.most[i] > 0:
                at = int(self.first[i])
                out.append([self.docs[at], at, int(self.first[i + 1]), int(self.most[i]) * times, times])
        return out

    def best(self, terms: dict[int, int], k: int) -> list[tuple[int, int]]:
        """(score, place) of the ``k`` best documents; of equal scores the first places."""
        docs, gains = self.docs, self.gains
        cursors = self.lists(terms)
        heap: list[tuple[int, int]] = []  # (score, -place): of equal scores the last place leaves first
        floor = 0
        while cursors:
            cursors.sort()
            bound = 0
            for i, c in enumerate(cursors):  # the pivot: where the sum of maxima first exceeds the floor
                bound += c[3]
                if bound > floor:
                    break
            else:
                break
            pivot, ended = c[0], False
            if cursors[0][0] == pivot:
                score = 0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += gains[c[1]] * c[4]
                    c[1] += 1
                    if c[1] < c[2]:
                        c[0] = docs[c[1]]
                    else:
                        c[0], ended = -1, True
                if score > floor:
                    if len(heap) == k:
                        heapq.heapreplace(heap, (score, -pivot))
                    else:
                        heapq.heappush(heap, (score, -pivot))
                    if len(heap) == k:
                        floor = heap[0][0]
            else:
                for c in cursors[:i]:
                    if c[0] < pivot:
                        c[1] = bisect_left(docs, pivot, c[1], c[2])
                        if c[1] < c[2]:
                            c[0] = docs[c[1]]
                        else:
                            c[0], ended = -1, True
            if ended:
                cursors = [c for c in cursors if c[0] >= 0]
        return [(score, -place) for score, place in heap]


def search_shards(counts: DataFrame, queries: list[tuple[int, int | None, dict[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): at most ``k`` rows for each query and shard."""
    sent = counts.sparkSession.sparkContext.broadcast((queries, weights))  # of a block of queries

    def found(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        asked, weights = sent.value
        shard = Shard(batches, weights, n_docs, n_terms)
        rows = [(q, item, shard.ids[place], score) for q, item, terms in asked for score, place in shard.best(terms, k)]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["query", "item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= SHARD:
                yield found(held)
                held, size = [], 0
        if held:
            yield found(held)

    return counts.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """Queries with their terms, as many at a time as have ``BLOCK_TERMS`` terms."""
    block, size = [], 0
    for row in queries.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        terms = Counter(terms_of((row.text or "").encode()))
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, terms))
        size += len(terms)
    if size:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) for each query (item_id, text)."""
    spark, parts, asked = docs.sparkSession, [], 0
    for block in _blocks(queries):
        vocabulary = sorted(set().union(*(terms for _, terms in block)))
        number = {t: i for i, t in enumerate(vocabulary)}
        counts = staged(term_counts(docs, vocabulary), "term-counts")
        n_docs, n_terms = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(vocabulary), np.int64)
        # a row for each term of the block at most
        for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        wanted = [(asked + i, item, {number[t]: c for t, c in terms.items()}) for i, (item, terms) in enumerate(block)]
        parts.append(search_shards(counts.where(F.size("terms") > 0), wanted, weights, n_docs, n_terms, k))
        asked += len(block)
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def oracle(k: int = K) -> str:
    """The same rows by scoring every document for every item."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH words AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
stat AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0),
asked AS (SELECT query, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS query, item_id, unnest({words}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM words)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * stat.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stat GROUP BY term, stat.n),
gain AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * stat.n) // stat.l))) AS gain FROM tf JOIN weight USING (term), stat),
scored AS (SELECT query, item_id, row, doc_id, sum(times * gain)::BIGINT AS score FROM asked JOIN gain USING (term) GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
