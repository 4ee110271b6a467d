"""Near copies at a Jaccard similarity of 0.8 of five-word shingles, from SimHash links on.

Operator 10 links fingerprints of at most 3 differing bits. Texts at similarity
0.8 differ in about 10 of 64 bits, a radius at which vantage-point trees prune
nothing, so its links are the first step here and not the last:

1. Tasks hash the shingles of each text. Equal shingle sets form a class with a
   SimHash fingerprint, and only classes are searched; ``BANDS * ROWS`` minima
   of the set make ``BANDS`` band hashes.
2. Operator 10 links the fingerprints of the classes through its trees.
3. Classes that share a band are candidates. A pair at similarity s shares no
   band with probability (1 - s ** 5) ** 24: 7e-5 at 0.8, 1e-6 at 0.85. Each
   class meets four pivots of every band that still holds several components.
4. Links of both steps count only if the exact similarity of the two sets is at
   least 0.8.
5. A band that still holds several components is compared whole, in blocks, in
   tasks that count shared shingles by matrix products and return a spanning
   forest of the exact links, so that no step makes a row for each pair.
6. Links are joined to components; one row of each component stays.

A row is known by two hashes of its id and text, never by its id alone.

Edge cases: a null, empty or blank text has no shingles and equals any other
such text; fewer words than a shingle are one; null ids come last; of rows with
equal id and text one stays; other columns are ignored and returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm import simhash
from factlake.llm.common import small, staged, text_batches
from factlake.llm.simhash import Forest
from factlake.operators.graph import components

SHINGLE, SEED = 5, 42
BANDS, ROWS = 24, 5
#: Classes of one band that a task compares with those of another block.
BLOCK = 1024
#: Shingles counted at once in a block.
COLUMNS = 4096
_rng = np.random.default_rng(5)
FACTORS, SHIFTS = _rng.integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
FACTORS |= np.uint64(1)
KEY = ["__k1", "__k2"]


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n, k = b" ".join(words), len(words), min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes)
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - sizes).tolist(), (ends - 1).tolist()[k - 1 :], strict=False)
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n - k + 1))


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of a set's minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 2048):
        low = np.minimum(low, (found[i : i + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of each row; rows of equal id and text share it."""
    key = [F.xxhash64(F.col("doc_id").cast("long"), "text"), F.xxhash64("text", F.lit(1), F.col("doc_id").cast("long"))]
    return docs.withColumns(dict(zip(KEY, key, strict=True)))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The row of smallest id, nulls last, of each component of ``rows`` (doc_id, key, component)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    first = rows.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = staged(rows.join(small(first), "component").select(*KEY, "first"), "groups")
    kept = (F.col(KEY[0]) == F.col(f"first.{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"first.{KEY[1]}"))
    gone = groups.where(~kept).select(*KEY).distinct()
    twice = staged(groups.where(kept).groupBy(*KEY).count().where("count > 1").select(*KEY), "twice")
    out = keyed(docs).join(small(gone), KEY, "left_anti")
    if twice.limit(1).count():
        # rows of equal id and text
        twice = small(twice)
        out = out.join(twice, KEY, "left_anti").unionByName(out.join(twice, KEY, "left_semi").dropDuplicates(KEY))
    return out.select(*docs.columns)


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, key, node (hash of the set), n (its size), fp, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # one text at a time: only its hashes stay
            node, sizes, fps, flat = [], [], [], []
            for t in b.column(3):
                s = shingles(t.as_py())
                node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                fps.append(simhash.majority(s))
                flat.append(bands(s))
            flat = np.concatenate([*flat, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fps)]
            columns = [*b.columns[:3], signed[0], pa.array(sizes, pa.int64()), signed[1], lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEY, "node", "n", "fp", "bands"])

    rows = keyed(text_batches(docs)).select(F.col("doc_id").cast("long"), *KEY, "text")
    return rows.mapInArrow(run, f"doc_id long, {KEY[0]} long, {KEY[1]} long, node long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = keyed(docs).join(small(nodes), KEY).select("node", "text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is at least 0.8."""
    one = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    found, column, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a shingle of one set is shared with none
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        table = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        table[owner[a:b], column[a:b] - lo] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b): a spanning forest of the exact links between the two blocks of a cell."""
    rows = rows.sort_values(["side", "node"])
    node, sets, side = rows["node"].to_numpy(), list(rows["shingles"]), rows["side"].to_numpy()
    left = np.nonzero(side == 0)[0]
    right = np.nonzero(side == 1)[0] if (side == 1).any() else left
    n, c = np.array([len(s) for s in sets]), pd.factorize(rows["c"])[0]
    forest = Forest(len(node))
    for i in range(0, len(left), 256):
        part = left[i : i + 256]
        shared = shared_counts([sets[k] for k in part], [sets[k] for k in right])
        linked = (9 * shared >= 4 * (n[part][:, None] + n[right][None, :])) & (c[part][:, None] != c[right][None, :])
        a, b = np.nonzero(linked)
        forest.link(part[a], right[b])
    root = forest.root(np.arange(len(node)))
    new = root != np.arange(len(node))
    return pd.DataFrame({"a": node[new], "b": node[root[new]]})


def _blockwise(mixed: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): exact links inside each band of ``mixed`` (band, node, c), block by block.

    A band of ``BLOCK`` classes or fewer is one cell; a larger one has a cell for
    every two blocks, so a class is sent once for each block of its band.
    """
    rows = mixed.join(small(sizes.select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))), "band")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    rows = rows.select("band", *cell, "node", "c", (F.col("own") > F.col("other")).cast("int").alias("side"))
    return rows.join(sets, "node").groupBy("band", "i", "j").applyInPandas(_compare, "a long, b long")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): confirmed pairs of nodes that connect every component."""
    classes = rows.groupBy("node").agg(
        F.min(F.struct(*KEY)).alias("key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
    )
    classes = staged(classes.where("n > 0").select("node", "n", "key.*", "fp", "bands"), "classes")
    # operator 10: classes of one fingerprint meet the first of them, and those meet through the trees
    heads = staged(classes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("k")), "fingerprints")
    same = heads.where("k > 1").select("fp", F.col("node").alias("a"))
    near = classes.select("fp", F.col("node").alias("b")).join(small(same), "fp").where("a <> b").select("a", "b")
    near = staged(near.unionByName(simhash.links(heads.select("node", "fp"))), "simhash-links")

    # most bands hold one class and are dropped by a narrow count before anything else is asked of them
    each = classes.select("node", F.col("n").cast("long"), F.explode("bands").alias("band"))
    shared = staged(each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    members = staged(each.join(small(shared), "band"), "members")
    other = lambda seed: F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(seed)))
    pivots = staged(members.groupBy("band").agg(F.array(*map(other, range(4))).alias("pivots")), "pivots")
    nodes = members.select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = staged(_sets(docs, classes.select("node", *KEY).join(small(staged(nodes, "nodes")), "node", "left_semi")), "sets")

    # a smaller set can only reach 0.8 of one at most a quarter larger
    alike = "5 * least(n, m) >= 4 * greatest(n, m)"
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    met = members.join(small(pivots, 20_000), "band")
    first = met.select("node", "n", F.explode("pivots").alias("p")).select("node", "n", F.col("p.node").alias("other"), F.col("p.n").alias("m"))
    first = first.where(f"node <> other AND {alike}").select(*pair)
    found = staged(_confirmed(near.unionByName(first).distinct(), sets), "links")

    # bands of up to four classes have met whole
    known = staged(components(found), "known")
    labelled = members.where("size > 4").join(small(known), "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    labelled = staged(labelled, "labelled")
    mixed = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    mixed = labelled.join(small(staged(mixed, "mixed")), "band", "left_semi")
    return found.unionByName(_blockwise(mixed, shared.select("band", "size"), sets))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id."""
    rows = staged(_hashed(docs), "shingled")
    label = small(staged(components(staged(links(docs, rows), "all-links")), "components"))
    rows = rows.join(label, "node", "left").select("doc_id", *KEY, F.coalesce("component", "node").alias("component"))
    return keep_first(docs, rows)
