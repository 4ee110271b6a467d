"""A stored inverted index for lexical ranking.

Under the index's folder every added table of documents is a segment: ``docs`` has
the length of each document, ``postings`` the postings by term in blocks of at most
``BLOCK``, dealt to ``BUCKETS`` folders by a hash of the term and sorted by it, so
that a search reads the folders and row groups of its terms alone. Terms are counted
inside their batch of documents, and postings of a term in a batch go through the one
shuffle as lists. A block holds documents of one slice of them, by a hash of the id. Inside a term
blocks go from the largest contributions to the smallest; each has its largest
term frequency and its shortest document, which bound what it can add to a score
whatever the average length has become.

A search prunes by these bounds: the sums over the first blocks of a query's terms
give a score that ``limit`` documents reach; a block whose bound, with the largest
bounds of the query's other terms, stays below it cannot hold a better document,
and is not opened. What is left is summed exactly. Statistics are those of all
documents that were added and not removed.

Removed documents are listed, with what they take from the frequencies of their
terms; ``merge`` folds all segments into one. A manifest names the segments in
force and is written last, so a write that fails half-way changes nothing.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators.blocks import by_id, rounded, top_columns, without_own
from factlake.operators.lexjoin import counted
from factlake.operators.ranking import K1, TIES, B, query_terms, tokens, top
from factlake.staging import new_dir, shared_dir, small, staged

BLOCK, BUCKETS = 128, 32
#: Documents of a term that one window orders; more are dealt in slices.
SLICE = 1 << 16
#: Terms that a search names in its filters, and pairs of a query and a term sent to tasks; more are joined.
NAMED, SENT = 20_000, 100_000
#: Queries that meet a slice at once, and of a tile; cells that few slices are made to, and queries that a cell has then.
ASKED, TILE, CELLS, LEAST = 1024, 64, 32, 8
#: Scores are rounded to six digits, so bounds leave this much.
MARGIN = 1e-5
#: Rows kept beyond the limit of one search; if all of them are equal, the rest is looked for again.
EQUAL = 1000


def _sat(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _bucket(term: str = "term") -> Column:
    """The folder of a term; ``zlib.crc32`` gives the same on the driver."""
    return (F.crc32(F.col(term).cast("binary")) % BUCKETS).cast("int")


def _slice(slices: Column) -> Column:
    return F.pmod(F.xxhash64("id"), slices).cast("int")


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where values are, nulls too."""
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _chunk(term: pa.Array, slice_: pa.Array, tag: pa.Array, ids: pa.Array, tf: pa.Array, length: pa.Array) -> pa.RecordBatch:
    """Postings as a row for each term, slice and tag."""
    group = [_codes(term), slice_.to_numpy(), _codes(tag)]
    order = np.lexsort(group[::-1])
    new = np.zeros(len(order), dtype=bool)
    for g in group:
        new[1:] |= g[order][1:] != g[order][:-1]
    new[:1] = True
    first = np.flatnonzero(new)
    ends, at, one = np.append(first, len(order)), pa.array(order), pa.array(order[first])
    lists = [_lists(x.take(at), ends) for x in (ids, tf, length)]
    return pa.RecordBatch.from_arrays([term.take(one), slice_.take(one), tag.take(one), *lists], names=["term", "slice", "tag", "ids", "tfs", "lens"])


def _chunks_of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, tag, slice, len, terms, tfs), a row for each document."""
    for b in batches:
        row = pa.array(np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False)))
        of = [b.column(i).take(row) for i in range(4)]
        yield _chunk(b.column(4).flatten(), of[2], of[1], of[0], b.column(5).flatten(), of[3])


def _chunks_of_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (term, slice, tag, id, tf, len), a row for each posting."""
    for b in batches:
        yield _chunk(*b.columns)


def _blocks_of(mean: float, size: int):
    """Chunks (bucket, slice, term, tag, ids, tfs, lens) in the order of the first three, as blocks of at most ``size``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # chunks of the last term, of which more may come
        for b in batches:
            rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            rows = rows.combine_chunks()
            group = [rows[c].to_numpy() if c != "term" else _codes(rows[c].combine_chunks()) for c in ("bucket", "slice", "term")]
            new = reduce(np.logical_or, (g[1:] != g[:-1] for g in group), np.zeros(max(0, len(rows) - 1), dtype=bool))
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            kept = rows.slice(last)
            if last:
                yield made(rows.slice(0, last), new[: last - 1])
        if kept is not None and len(kept):
            yield made(kept, np.zeros(len(kept) - 1, dtype=bool))

    def made(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = {c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in rows.column_names}
        held = pc.list_value_length(column["ids"]).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rows)), held)
        ids, tf, length = (column[c].flatten() for c in ("ids", "tfs", "lens"))
        t, x = tf.to_numpy(), length.to_numpy()
        impact = t * (K1 + 1) / (t + K1 * (1 - B + B * x / mean))
        group = np.concatenate([[0], np.cumsum(new)])[row]
        table = pa.table([pa.array(group), pa.array(impact), ids], names=["g", "impact", "id"])
        order = pc.sort_indices(table, sort_keys=[("g", "ascending"), ("impact", "descending"), ("id", "ascending")]).to_numpy()
        group = group[order]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        first = np.flatnonzero(place % size == 0)
        ends, at, one = np.append(first, len(order)), pa.array(order), pa.array(row[order][first])
        lists = [_lists(v.take(at), ends) for v in (ids, tf, length, column["tag"].take(pa.array(row)))]
        numbers = [place[first] // size, np.diff(ends), np.maximum.reduceat(t[order], first), np.minimum.reduceat(x[order], first)]
        return pa.RecordBatch.from_arrays(
            [*[column[c].take(one) for c in ("bucket", "slice", "term")], *[pa.array(v.astype(np.int32)) for v in numbers], *lists],
            names=["bucket", "slice", "term", "block", "n", "best_tf", "least_len", "ids", "tfs", "lens", "tags"],
        )

    return blocks


def _scored(asked: pa.Table, blocks: pa.Table, limit: int, mean: float, same: bool, but_own: bool) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(query_id, id, score) of the best of each query in a slice. ``asked`` has query_id, term, idf, least and same, and gone,
    a removed document, where term is null; a block counts for a query if its bound reaches ``least``."""
    gone = pc.unique(pc.drop_null(asked["gone"])) if len(asked) else pa.array([], asked.schema.field("gone").type)
    asked = asked.filter(pc.is_valid(asked["term"])).sort_by("query_id").combine_chunks()
    blocks = blocks.combine_chunks()
    none = (asked["query_id"].slice(0, 0), pa.array([], asked.schema.field("gone").type), np.zeros(0))
    if not len(asked) or not len(blocks):
        return none
    flat = {c: (blocks[c].combine_chunks() if isinstance(blocks[c], pa.ChunkedArray) else blocks[c]).flatten() for c in ("ids", "tfs", "lens", "tags")}
    docs = pc.unique(flat["ids"])
    docs = docs.take(pc.sort_indices(docs))
    doc = pc.index_in(flat["ids"], docs).to_numpy()
    tf, length = flat["tfs"].to_numpy().astype(float), flat["lens"].to_numpy()
    held = blocks["n"].to_numpy().astype(np.int64)
    first = np.cumsum(held) - held
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    best = blocks["best_tf"].to_numpy().astype(float)
    bound = best * (K1 + 1) / (best + K1 * (1 - B + B * blocks["least_len"].to_numpy() / mean))
    terms = pc.unique(blocks["term"])
    of_block = pc.index_in(blocks["term"], terms).to_numpy()
    order = np.argsort(of_block, kind="stable")
    ends = np.searchsorted(of_block[order], np.arange(len(terms) + 1))
    at = pc.fill_null(pc.index_in(asked["term"], terms), -1).to_numpy()
    idf, least = asked["idf"].to_numpy(), asked["least"].to_numpy()
    queries = pc.unique(asked["query_id"])
    starts = np.append(np.unique(pc.index_in(asked["query_id"], queries).to_numpy(), return_index=True)[1], len(asked))
    removed = pc.is_in(docs, gone).to_numpy(zero_copy_only=False)
    if same:
        # a document has one tag
        tag = pa.array(np.zeros(len(docs), dtype=np.int64))
        where = np.zeros(len(docs), dtype=np.int64)
        where[doc] = np.arange(len(doc))
        tag = flat["tags"].take(pa.array(where))
    rows, columns, scores = [], [], []
    for i in range(0, len(queries), TILE):
        tile = min(TILE, len(queries) - i)
        score = np.zeros((tile, len(docs)))
        for j in range(tile):
            a, b = starts[i + j], starts[i + j + 1]
            for t, weight, floor in zip(at[a:b], idf[a:b], least[a:b], strict=True):
                if t < 0:
                    continue
                mine = order[ends[t] : ends[t + 1]]
                mine = mine[weight * bound[mine] >= floor]
                size = held[mine]
                if len(mine):
                    post = np.repeat(first[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    score[j, doc[post]] += weight * part[post]  # a document is once in a term
            if same:
                wanted = asked["same"][int(a)].as_py()
                equal = pc.is_null(tag) if wanted is None else pc.fill_null(pc.equal(tag, wanted), False)
                score[j, ~equal.to_numpy(zero_copy_only=False)] = 0.0
        score = np.where((score > 0) & ~removed, rounded(score), -np.inf)
        if but_own:
            without_own(score, queries.slice(i, tile).to_numpy(zero_copy_only=False), docs.to_numpy(zero_copy_only=False))
        row, column = top_columns(score, limit)
        rows.append(row + i)
        columns.append(column)
        scores.append(score[row, column])
    row, column = np.concatenate(rows), np.concatenate(columns)
    return queries.take(pa.array(row)), docs.take(pa.array(column)), np.concatenate(scores)


@dataclass(frozen=True)
class State:
    """A version: its segments, up to which version removals are folded in, whether there are later ones, documents and their terms."""

    version: int = -1
    segments: list[int] = field(default_factory=list)
    folded: int = -1
    gone: bool = False
    n: int = 0
    total: int = 0


class Index:
    """An index in a folder. ``id`` is the type of document ids, ``tag`` a column that searches may ask to be equal."""

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "long") -> None:
        self.spark, self.id_type = spark, id_type
        self.path = path or new_dir(spark, "postings")
        self._known: State | None = None

    # ---- what is stored ------------------------------------------------------------

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def state(self) -> State:
        """What is in force; the manifest has a row for each version. Read once: ``refresh`` sees what others wrote since."""
        if self._known is None:
            rows = self._read("manifest", "version int, segments array<int>, folded int, gone boolean, n long, total long").orderBy(F.desc("version")).limit(1).collect()
            self._known = State(*rows[0]) if rows else State()
        return self._known

    def refresh(self) -> None:
        self._known = None

    def _commit(self, state: State) -> None:
        """The state of the next version."""
        row = (state.version + 1, state.segments, state.folded, state.gone, state.n, state.total)
        rows = self.spark.createDataFrame([row], "version int, segments array<int>, folded int, gone boolean, n long, total long")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._known = replace(state, version=state.version + 1)

    def _segments(self, part: str, schema: str) -> DataFrame:
        found = [self._read(f"segment-{s}/{part}", schema) for s in self.state().segments]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def docs(self) -> DataFrame:
        """(id, len) of the documents in force."""
        rows, gone = self._segments("docs", f"id {self.id_type}, len int"), self.removed()
        return rows if gone is None else rows.join(gone, "id", "left_anti")

    def removed(self) -> DataFrame | None:
        """(id) of removed documents that segments still hold; None if there are none."""
        state = self.state()
        return self._read("removed", f"version int, id {self.id_type}").where(F.col("version") > state.folded).select("id").distinct() if state.gone else None

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, slices, slice, block, n, best_tf, least_len, ids, tfs, lens, tags) of all segments, or of the terms."""
        schema = f"term string, slices int, slice int, block int, n int, best_tf int, least_len int, ids array<{self.id_type}>, tfs array<int>, lens array<int>, tags array<string>, bucket int"
        rows = self._segments("postings", schema)
        if terms is not None:
            buckets = {zlib.crc32(t.encode()) % BUCKETS for t in terms}
            rows = rows.where(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(terms))
        return rows

    def frequencies(self, rows: DataFrame) -> DataFrame:
        """(term, df) from blocks, less the removed documents."""
        state, both = self.state(), rows.select("term", F.col("n").cast("long").alias("n"))
        if state.gone:
            gone = self._read("gone", "version int, term string, n long").where(F.col("version") > state.folded)
            both = both.unionByName(gone.select("term", (-F.col("n")).alias("n")))
        return both.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    # ---- writes ----------------------------------------------------------------------

    def add(self, docs: DataFrame, text: str = "content", tag: str | None = None) -> None:
        """A new segment of documents (id, ``text``). Ids that are in the index already must be removed first."""
        words = docs.select("id", tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"), (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"))
        counts = counted(words, ["id", "tag"])

        def chunks(slice_: Column) -> DataFrame:
            return counts.select("id", "tag", slice_.alias("slice"), "len", "terms", "tfs").mapInArrow(_chunks_of_docs, self._chunk_schema())

        self._commit(self._write(words.select("id", F.size("w").alias("len")), chunks))

    def _chunk_schema(self) -> str:
        return f"term string, slice int, tag string, ids array<{self.id_type}>, tfs array<int>, lens array<int>"

    def _write(self, lens: DataFrame, chunks: Callable[[Column], DataFrame]) -> State:
        """The state with a further segment: documents (id, len), and their postings in chunks, given the slice of an id."""
        state = self.state()
        mine = max(state.segments, default=-1) + 1
        path = f"{self.path}/segment-{mine}"
        lens.write.mode("overwrite").parquet(f"{path}/docs")
        n, total = self.spark.read.schema(f"id {self.id_type}, len int").parquet(f"{path}/docs").agg(F.count("*"), F.sum("len")).first()
        slices = max(1, -(-n // SLICE))
        # a file for each folder and slice, up to a number of slices, sorted by term
        rows = chunks(_slice(F.lit(slices))).withColumn("bucket", _bucket()).repartition(BUCKETS * min(slices, 256), "bucket", "slice")
        rows = rows.select("bucket", "slice", "term", "tag", "ids", "tfs", "lens").sortWithinPartitions("bucket", "slice", "term")
        schema = f"bucket int, slice int, term string, block int, n int, best_tf int, least_len int, ids array<{self.id_type}>, tfs array<int>, lens array<int>, tags array<string>"
        blocks = rows.mapInArrow(_blocks_of(max(1.0, (total or 0) / max(1, n)), BLOCK), schema).withColumn("slices", F.lit(slices))
        blocks.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        return replace(state, segments=[*state.segments, mine], n=state.n + n, total=state.total + (total or 0))

    def remove(self, ids: DataFrame) -> None:
        """Take documents (id) out of all results and statistics."""
        state = self.state()
        gone = staged(self.docs().join(ids.select("id").distinct(), "id", "left_semi"), "removed-ids")
        n, total = gone.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        lost = self._exploded(self.postings()).join(small(gone.select("id")), "id", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
        at = F.lit(state.version + 1).alias("version")
        lost.select(at, "term", "n").write.mode("append").parquet(f"{self.path}/gone")
        gone.select(at, "id").write.mode("append").parquet(f"{self.path}/removed")
        self._commit(replace(state, gone=True, n=state.n - n, total=state.total - total))

    def merge(self) -> None:
        """Fold all segments into one, without the removed documents."""
        rows, gone = self._exploded(self.postings()), self.removed()
        rows = rows if gone is None else rows.join(gone, "id", "left_anti")
        old = self.state()

        def chunks(slice_: Column) -> DataFrame:
            return rows.select("term", slice_.alias("slice"), "tag", "id", "tf", "len").mapInArrow(_chunks_of_postings, self._chunk_schema())

        new = self._write(self.docs(), chunks)
        self._commit(replace(old, segments=new.segments[-1:], folded=old.version + 1, gone=False))

    # ---- reads -----------------------------------------------------------------------

    @staticmethod
    def _exploded(blocks: DataFrame, *keep: str) -> DataFrame:
        """A row (id, tf, len, tag) for each posting."""
        x = F.explode(F.arrays_zip("ids", "tfs", "lens", "tags")).alias("x")
        return blocks.select("term", *keep, x).select("term", *keep, F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"), F.col("x.lens").alias("len"), F.col("x.tags").alias("tag"))

    def search_many(self, queries: DataFrame, limit: int, same: str | None = None, but_own: bool = False, average: float | None = None) -> DataFrame:
        """(query_id, id, score): the ``limit`` best documents of each query (query_id, query), with exact
        scores to six digits, and some of the rest, whose scores may be short of blocks that were not opened. Scores are
        summed in cells of a slice of documents and a group of queries, so that no posting is a row.

        ``same`` names a column of the queries that must equal the document's tag, nulls being
        equal, and ``but_own`` leaves out the document with the query's id. ``average`` stands in
        for the average length.
        """
        asked = queries.select("query_id", *[F.col(c).cast("string").alias("__same") for c in [same] if c], F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
        asked = staged(asked, "asked-terms")
        few = [r["term"] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        blocks = self.postings(few) if len(few) <= NAMED else self.postings().join(asked.select("term").distinct(), "term", "left_semi")
        # rows of a query and a term, or of either, are sent to tasks up to a number of them
        sent = F.broadcast if asked.limit(SENT + 1).count() <= SENT else (lambda df: df)
        state, gone = self.state(), self.removed()
        n, mean = state.n, F.lit(float(average or (state.total / state.n if state.total else 1.0)))
        heads = blocks.select("term", "block", "n", "best_tf", "least_len")  # no arrays are read
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = staged(self.frequencies(heads).join(sent(asked.select("term").distinct()), "term", "left_semi").select("term", idf.alias("idf")), "weights")
        bound = F.col("idf") * _sat(F.col("best_tf"), F.col("least_len"), mean)
        most = heads.join(sent(weights), "term").groupBy("term").agg(F.max(bound).alias("most"))
        terms = asked.join(sent(most.join(sent(weights), "term")), "term")
        sums = terms.groupBy("query_id").agg(F.sum("most").alias("all"))
        terms = staged(terms.join(sent(sums), "query_id"), "asked-bounds")
        counts = [r["slices"] for r in blocks.select("slices").distinct().collect()]
        # few slices meet the queries in more groups, so that there are cells for all cores
        many = queries.count()
        groups = max(1, -(-many // ASKED), min(-(-many // LEAST), -(-CELLS // max(1, sum(counts)))))
        terms = terms.withColumn("__group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        schema = f"query_id {dict(queries.dtypes)['query_id']}, id {self.id_type}, score double"
        by_same, average_len = same is not None, float(average or (state.total / state.n if state.total else 1.0))

        def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
            return pa.table(list(_scored(asked, rows, limit, average_len, by_same, but_own)), names=["query_id", "id", "score"])

        def parts(rows: DataFrame, asked: DataFrame) -> DataFrame:
            """The best of each query in each slice."""
            groups = asked.select("__group").distinct()
            wanted = asked.select("query_id", "term", "idf", "least", (F.col("__same") if by_same else F.lit(None).cast("string")).alias("same"), F.lit(None).cast(self.id_type).alias("gone"), "__group")
            spaces = self.spark.createDataFrame([(c, i) for c in counts for i in range(c)], "slices int, slice int")
            sides = wanted.crossJoin(F.broadcast(spaces))  # a row for each slice of a segment
            if gone is not None:
                lost = gone.crossJoin(F.broadcast(spaces.select("slices").distinct())).withColumn("slice", _slice(F.col("slices"))).crossJoin(F.broadcast(groups))
                sides = sides.unionByName(lost.select("slices", "slice", "__group", F.col("id").alias("gone")), allowMissingColumns=True)
            # a block goes to the queries it can matter to
            reach = asked.groupBy("term", F.col("__group").alias("__to")).agg(F.min("least").alias("__least"), F.first("idf").alias("idf"))
            held = rows.join(sent(reach), "term").where(bound >= F.col("__least")).select("slices", "slice", "__to", "term", "n", "best_tf", "least_len", "ids", "tfs", "lens", "tags")
            return sides.groupBy("slices", "slice", "__group").cogroup(held.groupBy("slices", "slice", "__to")).applyInArrow(best, schema)

        first = parts(blocks.where("block = 0"), terms.withColumn("least", F.lit(float("-inf"))))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"))
        reached = first.withColumn("k", F.row_number().over(by)).where(F.col("k") == limit).select("query_id", F.col("score").alias("reached"))
        reached = staged(reached, "reached")
        open_ = terms.join(sent(reached), "query_id", "left").withColumn("least", F.coalesce("reached", F.lit(0.0)) - MARGIN - F.col("all") + F.col("most"))
        return parts(blocks, open_)

    def search(self, query: str, limit: int, docs: DataFrame | None = None, average: float | None = None) -> DataFrame:
        """(id, score, rank): the ``limit`` best documents. Equal scores go by the columns ``TIES`` of ``docs``,
        which is read for those ids only, and only if scores are equal."""
        state, gone = self.state(), self.removed()
        terms = query_terms(query)
        blocks = self.postings(terms)
        # a row for each term of the query
        weights = {x["term"]: math.log1p((state.n - x["df"] + 0.5) / (x["df"] + 0.5)) for x in self.frequencies(blocks).collect()} if terms else {}
        if not weights:
            return self.spark.createDataFrame([], f"id {self.id_type}, score double, rank int")
        mean = F.lit(float(average or state.total / max(1, state.n) or 1.0))
        idf = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]
        bounds = blocks.where(F.col("term").isin(list(weights))).withColumn("idf", idf).withColumn("bound", F.col("idf") * _sat(F.col("best_tf"), F.col("least_len"), mean))

        def parts(rows: DataFrame) -> DataFrame:
            each = self._exploded(rows, "idf")
            each = each if gone is None else each.join(gone, "id", "left_anti")
            return each.groupBy("id").agg(F.sum(F.col("idf") * _sat(F.col("tf"), F.col("len"), mean)).alias("score"))

        most = {x["term"]: x["most"] for x in bounds.groupBy("term").agg(F.max("bound").alias("most")).collect()}
        first = parts(bounds.where("block = 0")).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if first["n"] == limit:
            others = F.create_map(*[F.lit(x) for t in most for x in (t, sum(most.values()) - most[t])])[F.col("term")]
            bounds = bounds.where(F.col("bound") + others >= first["least"] - MARGIN)
        found = staged(parts(bounds).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score")).limit(limit + EQUAL), "found")
        top_rows = found.agg(F.count("*").alias("n"), F.count_distinct("score").alias("d"), F.min("score").alias("last")).first()
        last = found.orderBy(F.desc("score")).limit(limit).agg(F.min("score")).first()[0]
        if top_rows["n"] == limit + EQUAL and top_rows["last"] == last:  # more of equal score than were kept
            found = staged(parts(bounds).select("id", F.round("score", 6).alias("score")).where(F.col("score") >= F.lit(last)), "found")
            top_rows = {"n": 1, "d": 0}
        reach = found.where(F.col("score") >= F.lit(last))
        n, different = top_rows["n"], top_rows["d"]
        order = [F.desc("score"), F.col("id")]
        if docs is not None and n > different:
            names = [c for c in TIES if c in docs.columns and c != "id"]
            reach = docs.select("id", *names).join(small(reach), "id")
            order = [F.desc("score"), *[F.asc_nulls_last(c) for c in names], F.col("id")]
        return top(reach, order, limit).select("id", "score", "rank")


def index_of(spark: SparkSession, docs: DataFrame, text: str = "content", tag: str | None = None) -> Index:
    """The index of a table of files in the shared folder, built when it is asked for first.

    Its name follows from the files' paths, sizes and times, and from the plan over
    them, so a changed table gets an index of its own.
    """
    meta = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").cast("string")
    files = docs.select(meta.alias("f")).distinct().agg(F.count("*"), F.sum(F.xxhash64("f").cast("decimal(20,0)"))).first()
    name = hashlib.sha256(f"slices {files[0]} {files[1]} {text} {tag} {','.join(docs.columns)}".encode()).hexdigest()[:16]
    index = Index(spark, f"{shared_dir(spark)}/postings-{name}", dict(docs.dtypes)["id"])
    if index.state().version < 0:
        index.add(docs, text, tag)
    return index
