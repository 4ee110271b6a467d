"""Approximate nearest neighbours in balanced posting lists.

1. Equal vectors form a class that keeps its ``k + 1`` smallest ids, so that a
   large group of copies is one point of the index.
2. Centroids are fitted on a bounded sample by k-means with a penalty on large
   clusters; a kNN graph with some long edges over the centroids is the
   in-memory index. Its size is bounded by ``MAX_LISTS``, whatever the input.
3. Tasks search that graph for every vector and put it in the list of its
   nearest centroid; a boundary vector is replicated to further ones within
   (1 + ``SPREAD``) of the nearest distance, up to ``MAX_COPIES`` lists. A list
   is passed over if its centroid lies nearer to one already chosen than
   ``APART`` times its distance from the vector, as it would hold the same rows.
4. Lists over ``SHARD`` rows are cut into shards by a hash.
5. A query searches the same graph, with a beam that doubles until it holds a
   centroid beyond (1 + ``PROBE``) of the nearest distance; it asks all lists
   within, and ``MIN_PROBES`` at least.
6. ``GROUP`` lists are one group of a task, and at most ``QUERIES`` probes of a
   group one part of it. A task finds the rows of each list that may be among the
   best of each query, up to the rounding of a matrix product, compares all of
   those in double precision, and keeps the best by distance, then id.

Edge cases: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part; fewer candidates than ``k``
give fewer rows; ties go to the smaller id; a query never finds its own row,
but finds its copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.llm.common import hashed_sample, staged

LIST_SIZE, MAX_LISTS, SAMPLE, SHARD = 200, 4096, 20_000, 4096
SPREAD, MAX_COPIES, APART = 0.15, 4, 0.8
PROBE, MIN_PROBES = 0.22, 8
DEGREE, BEAM, ENTRIES = 24, 40, 32
GROUP, QUERIES = 16, 50_000
#: Pairs compared exactly at a time.
PAIRS = 100_000


def usable(v: Column, length: Column | None = None) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Graph:
    """Centroids and a graph over them, searched by beams of many queries at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 3) -> None:
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        rng = np.random.default_rng(seed)
        near = min(DEGREE, n - 1)
        edges = np.zeros((n, near + 8), np.int64)
        for i in range(0, n, 512):
            d = self._all(self.c[i : i + 512])
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            edges[i : i + 512, :near] = np.argpartition(d, near - 1, axis=1)[:, :near] if near else 0
        edges[:, near:] = rng.integers(0, n, (n, 8))  # long edges keep far clusters reachable
        self.edges = edges
        self.entries = rng.permutation(n)[:ENTRIES]
        self.norms = (self.c * self.c).sum(axis=1)

    def _all(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (self.c * self.c).sum(axis=1)[None, :] - 2 * (x @ self.c.T)
        return np.maximum(d, 0)

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), nearest first, of ``want`` centroids for each row.

        A beam holds the best seen; each step opens every query's best
        unopened ones and meets their neighbours, until all in the beam are open.
        """
        n, q = len(self.c), len(x)
        beam = min(max(BEAM, want), n)
        wide = max(1, beam // 64)
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            dots = np.einsum("qd,qmd->qm", x, self.c[ids])
            return np.maximum((x * x).sum(axis=1)[:, None] + self.norms[ids] - 2 * dots, 0)

        ids = np.tile(self.entries, (q, 1))
        dist = distance(ids)
        seen[rows, ids] = True
        opened = np.zeros(ids.shape, bool)
        while True:
            best = np.where(opened, np.inf, dist)
            some = min(wide, best.shape[1])
            best = np.argpartition(best, some - 1, axis=1)[:, :some]
            fresh = np.isfinite(dist[rows, best]) & ~opened[rows, best]
            if not fresh.any():
                break
            opened[rows, best] = True
            new = np.where(fresh[:, :, None], self.edges[ids[rows, best]], ids[:, :1, None]).reshape(q, -1)
            d = distance(new)
            d[seen[rows, new]] = np.inf
            # an id that occurs twice among the edges counts once
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, axis=1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
            d[twice] = np.inf
            seen[rows, new] = True
            ids, dist = np.concatenate([ids, new], axis=1), np.concatenate([dist, d], axis=1)
            opened = np.concatenate([opened, np.zeros(new.shape, bool)], axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, opened = (np.take_along_axis(a, keep, axis=1) for a in (ids, dist, opened))
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1))


def fit(sample: np.ndarray, n_lists: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """Balanced k-means: a cluster's distances grow with its share of the rows."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    c = x[rng.permutation(len(x))[:n_lists]].copy()
    size = np.full(len(c), len(x) / len(c))
    for _ in range(rounds):
        penalty = (size / (len(x) / len(c))) * 0.05
        near = np.empty(len(x), np.int64)
        spread = max(float(x.var(axis=0).sum()), 1e-12)
        for i in range(0, len(x), 2048):
            b = x[i : i + 2048]
            d = (b * b).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (b @ c.T)
            near[i : i + 2048] = (d + penalty[None, :] * spread).argmin(axis=1)
        size = np.bincount(near, minlength=len(c)).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        c[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _posting_lists(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each vector's lists: its home and its boundary replicas."""
    ids, dist = graph.search(x, min(2 * MAX_COPIES, len(graph.c)))
    near = graph.c[ids]
    chosen = dist <= (1 + SPREAD) * dist[:, :1]
    for j in range(1, ids.shape[1]):
        between = np.sqrt(((near[:, :j] - near[:, j : j + 1]) ** 2).sum(axis=2))
        same = (chosen[:, :j] & (between <= APART * dist[:, j : j + 1])).any(axis=1)
        chosen[:, j] &= ~same & (chosen[:, :j].sum(axis=1) < MAX_COPIES)
    row, at = np.nonzero(chosen)
    return row, ids[row, at]


def _probes(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each query asks."""
    rows, lists, todo, want = [], [], np.arange(len(x)), 2 * MIN_PROBES
    while len(todo):
        ids, dist = graph.search(x[todo], min(want, len(graph.c)))
        within = dist <= (1 + PROBE) * dist[:, :1]
        done = ~within[:, -1] | (ids.shape[1] == len(graph.c)) | (want > 2 * len(graph.c))
        within[:, :MIN_PROBES] = True
        within &= np.isfinite(dist)
        row, at = np.nonzero(within[done])
        rows.append(todo[done][row])
        lists.append(ids[done][row, at])
        todo, want = todo[~done], 2 * want
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *lists])


def nearest_rows(p: np.ndarray, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``want`` nearest rows ``p`` of each query; equal distances go by row.

    The distances of a matrix product only tell which rows may be among them: all
    that are not beyond the ``want``-th by more than its rounding are compared exactly.
    """
    out = []
    norms = (p * p).sum(axis=1)
    for i in range(0, len(q), 256):
        b = q[i : i + 256]
        rough = norms[None, :] - 2 * (b @ p.T)
        last = np.partition(rough, want - 1, axis=1)[:, want - 1]
        slack = 64 * p.shape[1] * np.finfo(float).eps * (norms.max() + (b * b).sum(axis=1))
        at, row = np.nonzero(rough <= (last + slack)[:, None])
        exact = np.empty(len(at))
        for j in range(0, len(at), PAIRS):
            part = slice(j, j + PAIRS)
            exact[part] = np.sqrt(((b[at[part]] - p[row[part]]) ** 2).sum(axis=1))
        order = np.lexsort((row, exact, at))
        at, row, exact = at[order], row[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        out.append((i + at[place < want], row[place < want], exact[place < want]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spread(rows: DataFrame, model, choose) -> DataFrame:
    """Add ``list``: each row once for every list that ``choose`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = model.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                row, lists = choose(graph, _matrix(part.column(1)).astype(np.float32))
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists)], names=["node", "v", "list"])

    return rows.select("node", "v").mapInArrow(run, "node long, v array<float>, list long")


def classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((vec_id, v) of usable rows, (node, v, ids): distinct vectors)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = staged(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common[0] if common else 0))
    # adding 0.0 makes -0.0 and 0.0 the same component
    key = F.transform("v", lambda x: x + F.lit(0.0).cast("float"))
    first = Window.partitionBy("key").orderBy("vec_id")
    few = rows.select(key.alias("key"), "vec_id").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return rows, staged(ids.select(F.element_at("ids", 1).alias("node"), F.col("key").alias("v"), "ids"), "classes")


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found."""
    spark = vectors.sparkSession
    rows, points = classes(vectors, k)
    n = points.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = hashed_sample(points, SAMPLE, "node").select("v").toArrow()["v"].combine_chunks()
    sample = _matrix(sample)
    lists = int(min(MAX_LISTS, max(1, n // LIST_SIZE), len(sample)))
    model = spark.sparkContext.broadcast(Graph(fit(sample, lists)))

    queries = rows.where(is_query).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).alias("v"))
    asked = queries.join(points.select("node", F.col("v").alias("pv")), F.col("v") == F.col("pv")).select("vec_id", "node", "v")
    asked = staged(asked, "asked")
    posted = staged(_spread(points, model, _posting_lists), "posted")
    probes = _spread(asked.dropDuplicates(["node"]).select("node", "v"), model, _probes)
    # a list of many rows is cut into shards, and each query goes to all of them; a group that many
    # queries ask is cut into parts, and each row goes to all of them. Both tables have at most MAX_LISTS rows
    probes = staged(probes, "probes")
    group = F.floor(F.col("list") / GROUP).cast("int").alias("group")
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    parts = probes.groupBy(group).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    sizes = F.broadcast(sizes.withColumn("group", group).join(F.broadcast(parts), "group").select("list", "shards", "parts"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    posted = posted.join(sizes, "list").select("node", "v", "list", group, of("shards").alias("shard"), each("parts").alias("part"))
    probes = probes.join(sizes, "list").select("node", "v", "list", group, each("shards").alias("shard"), of("parts").alias("part"))

    def of_list(points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """The best rows of one list, in order of node, for each of its queries."""
        p, q = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (points, asks))
        at, row, score = nearest_rows(p, q, min(k + 1, len(p)))
        return pd.DataFrame({"node": asks["node"].to_numpy()[at], "found": points["node"].to_numpy()[row], "score": score})

    def nearest(points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        rows, out = dict(list(points.sort_values("node").groupby("list"))), []
        for number, mine in asks.groupby("list"):
            if number in rows:
                out.append(of_list(rows[number], mine))
        if not out:
            return pd.DataFrame({"node": [], "found": [], "score": []}).astype("int64")
        # a replica is found in several lists of the group
        best = pd.concat(out).sort_values(["node", "score", "found"]).drop_duplicates(["node", "found"])
        return best.groupby("node").head(k + 1)

    keys = ["group", "shard", "part"]
    found = posted.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(nearest, "node long, found long, score double")
    found = found.groupBy("node", "found").agg(F.min("score").alias("score"))
    by = Window.partitionBy("node").orderBy("score", "found")
    found = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    found = found.join(points.select(F.col("node").alias("found"), "ids"), "found")
    hits = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))))
    best = found.groupBy("node").agg(hits.alias("hits"))  # at most (k + 1) ** 2 entries
    own = F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id"))
    top = F.slice(F.sort_array(own), 1, k)
    out = asked.select("vec_id", "node").join(best, "node").select("vec_id", F.posexplode(top).alias("pos", "h"))
    return out.select(
        F.col("vec_id").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), "h.score"
    )
