"""SimHash near-duplicates, linked through vantage-point trees.

1. Each text gets a 64-bit fingerprint of its word shingles (numpy in tasks).
2. Equal fingerprints form a class with its smallest doc_id; only classes are
   searched, so a large group of copies is one point.
3. A vantage-point tree over a bounded sample cuts Hamming space into shards: a
   node holds a point v and a radius m, a fingerprint x goes left if
   d(x, v) <= m. By the triangle inequality a partner within ``max_bits`` of x
   can be left only if d(x, v) - max_bits <= m and right only if
   d(x, v) + max_bits > m, so each class is stored in one shard and asked in
   every later shard that its ball touches.
4. The tree's depth follows from the number of classes, so that a shard holds
   about ``SHARD`` of them; one that holds more is dealt in blocks, each block
   a shard that the later ones query. A task builds a vantage-point tree over
   its shard, walks it with all of its queries at once, and compares leaves bit
   by bit. It keeps a spanning forest of the links found, never all pairs.
5. The forests of all shards are joined to components by min-label
   propagation, with checkpoints.

Exact: no link is lost at any size. Where fingerprints lie evenly, a ball of 3
bits around a point touches both sides of a node about half of the time, so
the work grows as about n^1.6; the bounds, not the tree's depth, keep it right.

Edge cases: a null, empty or blank text has fingerprint zero and links like
any other; fewer words than a shingle hash as one; equal rows are one class; a
class whose ids are all null has a null component; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import hashed_sample, ranked, staged, text_batches
from factlake.operators.graph import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Classes that a shard is meant for, those beyond which it is dealt in blocks, and queries of one task.
SHARD, BLOCK, QUERIES = 32_768, 131_072, 400_000
#: Fingerprints sampled for the upper tree at least, and its largest depth; the size of a leaf in a task.
SAMPLE, DEEPEST, LEAF = 8192, 16, 256


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
    k = min(shingle, n)
    stops = (ends - 1).tolist()[k - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=False)), np.uint64, n - k + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = counts * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves the points best, if any does."""
    best = None
    for v in points[rng.integers(0, len(points), 8)]:
        d = _distance(points, v)
        m = int(np.median(d))
        for r in (m - 1, m):
            left = int((d <= r).sum())
            # a good node is even and has few points in the band it must send both ways
            cost = ((d > r - MAX_BITS) & (d <= r + MAX_BITS)).sum() + abs(2 * left - len(points))
            if 0 < left < len(points) and (best is None or cost < best[0]):
                best = (cost, v, r)
    return best and (best[1], best[2])


def build_tree(points: np.ndarray, depth: int, seed: int = 7) -> list[tuple[int, int] | None]:
    """Nodes in heap order, children of i at 2i+1 and 2i+2; None is not split."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int] | None] = [None] * (2**depth - 1)
    parts = {0: points}
    for i in range(len(nodes)):
        p = parts.pop(i, None)
        if p is None or len(p) < 2 or (cut := _split(p, rng)) is None:
            continue
        nodes[i] = (int(cut[0]), cut[1])
        left = _distance(p, cut[0]) <= cut[1]
        parts[2 * i + 1], parts[2 * i + 2] = p[left], p[~left]
    return nodes


def route(nodes: list[tuple[int, int] | None], fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard within ``reach`` of each fingerprint; reach 0 gives the home."""
    rows, out = [np.arange(len(fps))], []
    level = {0: rows[0]}
    while level:
        below: dict[int, np.ndarray] = {}
        for i, r in level.items():
            if i >= len(nodes) or nodes[i] is None:
                out.append((r, np.full(len(r), i)))
                continue
            v, m = nodes[i]
            d = _distance(fps[r], np.uint64(v)).astype(np.int64)
            for child, go in ((2 * i + 1, d - reach <= m), (2 * i + 2, d + reach > m)):
                if go.any():
                    below[child] = r[go]
        level = below
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


class Forest:
    """Components of growing sets of links, by label halving on arrays."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        up = self.label[x]
        while (self.label[up] != up).any():
            self.label[x] = up = self.label[up]
        return up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            a, b = (x[a != b] for x in (np.minimum(a, b), np.maximum(a, b))) if len(a) else (a, b)
            if len(a):
                np.minimum.at(self.label, b, a)


def _shard_links(points: np.ndarray, queries: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels of [points, queries]: linked ones of the shard share the smallest index."""
    forest, n = Forest(len(points) + len(queries)), len(points)
    both = np.concatenate([points, queries])
    rng = np.random.default_rng(11)
    todo = [(np.arange(n), np.arange(len(both)))]
    while todo:
        pts, asks = todo.pop()
        cut = None if len(pts) <= LEAF else _split(both[pts], rng)
        if cut is None:
            # a point asks only those at or after it
            for i in range(0, len(asks), 4096):
                for j in range(0, len(pts), 1024):
                    q, p = asks[i : i + 4096], pts[j : j + 1024]
                    at, to = np.nonzero(_distance(both[q][:, None], both[p][None, :]) <= max_bits)
                    keep = q[at] > p[to]
                    forest.link(q[at][keep], p[to][keep])
            continue
        v, m = cut
        d = _distance(both[pts], v).astype(np.int64)
        e = _distance(both[asks], v).astype(np.int64)
        todo.append((pts[d <= m], asks[e - max_bits <= m]))
        todo.append((pts[d > m], asks[e + max_bits > m]))
    return forest.root(np.arange(len(both)))


def depth_for(n: int) -> int:
    """Levels of the upper tree over ``n`` classes."""
    return min(DEEPEST, max(0, math.ceil(math.log2(max(1, n) / SHARD))))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect the classes (node, fp) of every component."""
    depth = depth_for(classes.count())
    sample = hashed_sample(classes, max(SAMPLE, 4 << depth), "fp").select("fp").toPandas()["fp"]
    nodes = build_tree(sample.to_numpy(np.int64).view(np.uint64), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = (np.asarray(b.column(i)) for i in range(2))
            x = fp.view(np.uint64)
            order, home = route(nodes, x, 0)
            mine = np.empty(len(x), np.int64)
            mine[order] = home
            rows, shards = route(nodes, x, max_bits)
            keep = shards >= mine[rows]
            rows, shards = rows[keep], shards[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards), pa.array(node[rows]), pa.array(fp[rows]), pa.array(shards == mine[rows])],
                names=["shard", "node", "fp", "home"],
            )

    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["home", "node"], ascending=[False, True])
        home, node = rows["home"].to_numpy(), rows["node"].to_numpy()
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        label = _shard_links(fp[home], fp[~home], max_bits)
        new = label != np.arange(len(label))
        return pd.DataFrame({"a": node[new], "b": node[label[new]]})

    placed = classes.select("node", "fp").mapInArrow(place, "shard long, node long, fp long, home boolean")
    placed = staged(placed, "placed")
    # at most 2 ** DEEPEST shards; only those with too many rows are dealt again
    sizes = placed.groupBy("shard").agg(F.ceil(F.count_if("home") / BLOCK).alias("blocks"), F.ceil(F.count_if(~F.col("home")) / QUERIES).alias("parts"))
    sizes = sizes.select("shard", F.greatest("blocks", F.lit(1)).cast("int").alias("blocks"), F.greatest("parts", F.lit(1)).cast("int").alias("parts"))
    rows = placed.join(F.broadcast(sizes), "shard")
    at = lambda n: F.pmod(F.xxhash64("node", F.col("shard")), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a point lives in its block for all parts, and queries the blocks before it; a query goes to all blocks
    homes = rows.where("home").withColumn("own", at("blocks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own"))))
    lives = F.col("block") == F.col("own")
    homes = homes.withColumn("part", F.explode(F.when(lives, upto("parts")).otherwise(F.array(at("parts"))))).withColumn("home", lives)
    asks = rows.where("NOT home").withColumn("block", F.explode(upto("blocks"))).withColumn("part", at("parts"))
    names = ["shard", "block", "part", "node", "fp", "home"]
    dealt = homes.select(*names).unionByName(asks.select(*names))
    return dealt.groupBy("shard", "block", "part").applyInPandas(connect, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    fps = staged(fingerprints(docs, shingle), "fingerprints")
    # numbered in order of their smallest id, those without any last: the first of a component has its smallest id
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = staged(ranked(classes, [F.asc_nulls_last("rep"), F.col("fp")], "node"), "classes")
    found = components(links(classes, max_bits))
    heads = classes.select(F.col("node").alias("head"), F.col("rep").alias("component_id"))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("head")).join(heads, "head")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
