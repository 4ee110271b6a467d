"""Exact similarity joins of vectors by angles to pivots.

The angle between vectors is a metric. Pivots are chosen from a bounded sample, each the
farthest from those before it, so that every cluster gets one; a vector's home is the
cell of its nearest pivot. If x and y are within an angle t, then

- angle(x, pivot of y) <= angle(x, its own pivot) + 2 t, as y is no nearer to the pivot of x,
- angle(x, pivot of y) <= radius of the cell of y + t,

so x visits the cells for which both hold. A pair of two cells is looked for in the
cell of the lower number alone, so it is found once. Inside a cell rows are sorted by
their angle to the pivot, and only those within t of each other are compared, by a
matrix product in blocks. Nothing is missed at any threshold; vectors without
structure prune little, and then all pairs of a namespace are compared.

A cell with many rows of one namespace is dealt in parts of ``PART`` rows, each pair of
parts a group of its own, so no task grows with the data.

Every visit is a copy of a row. Where pivots do not prune, rows would visit half of all
cells, so the number of pivots is chosen by a sample: as few as compare hardly more pairs
than the best number does, of those with ``COPIES`` copies of a row or less. A single cell
makes a copy for each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.staging import small, staged

#: Pivots at most, rows of a part, and rows of a block of a matrix product.
PIVOTS, PART, ROWS = 512, 32_768, 1024
#: Copies of a row that more pivots than one may make, on average.
COPIES = 8
#: Vectors that pivots are chosen from.
SAMPLE = 4096
#: Angles are rounded by this much at most, and cosines.
SLACK = 1e-6


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def choose_pivots(sample: np.ndarray, most: int, reach: float) -> np.ndarray:
    """Rows of the sample, each the farthest from those before, until all are within a fourth of ``reach`` of one."""
    chosen, far = [0], _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(most, len(sample)) and far.max() > reach / 4:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _enough(sample: np.ndarray, centre: np.ndarray, reach: float, largest: int) -> int:
    """How many of the pivots, from the first on, are worth their copies; ``largest`` is the size of the largest namespace."""
    angles, options, k = _angles(sample, centre), [], len(centre)
    while k:
        some = angles[:, :k]
        home, least = some.argmin(axis=1), some.min(axis=1)
        radii = np.full(k, -np.inf)
        np.maximum.at(radii, home, least)
        goes = (some <= least[:, None] + 2 * reach + SLACK) & (some <= radii + reach + SLACK) & (np.arange(k) < home[:, None])
        own = np.bincount(home, minlength=k) / len(sample)
        parts = np.ceil(own * largest / PART)
        copies = (goes @ parts + parts[home]).mean()
        options.append((k, copies, (own * (own / 2 + goes.mean(axis=0))).sum()))
        k //= 2
    options = [o for o in options if o[1] <= COPIES or o[0] == 1]
    best = min(o[2] for o in options)
    return min((o for o in options if o[2] <= 1.1 * best), key=lambda o: o[1])[0]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, ns, u) of the vectors (id, ns, v) that are not null or zero and have no null or odd component."""
    v = F.col("v").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select("id", "ns", v.alias("v"), norm.alias("n"))
    rows = rows.where((F.col("n") > 0) & ~F.isnan("n") & (F.col("n") < float("inf")))
    return rows.select("id", "ns", F.transform("v", lambda x: x / F.col("n")).alias("u"))


def dealt(vectors: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """(ns, cell, a, b, id, angle, home, u): each row in the groups (ns, cell, a, b) that compare it.

    A group holds rows of part a as homes, and rows of part b, or visitors, as the others.
    """
    id_type = dict(vectors.dtypes)["id"]
    rows = staged(unit_vectors(vectors), "unit-vectors")
    n = rows.count()
    some = min(pivots, max(1, 4 * math.isqrt(n)))
    # the first by a hash, from about twice as many
    at = F.shiftrightunsigned(F.xxhash64("id", "ns"), 11) / F.lit(float(2**53))
    sample = rows.withColumn("at", at).where(F.col("at") < (2 * SAMPLE + 100) / max(1, n)).orderBy("at", "id").limit(SAMPLE).select("u").toArrow()["u"].combine_chunks()
    if not len(sample):
        return rows.select("ns", F.lit(0).alias("cell"), F.lit(0).alias("a"), F.lit(0).alias("b"), "id", F.lit(0.0).alias("angle"), F.lit(True).alias("home"), "u").where("false")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    centre = _matrix(sample)
    largest = rows.groupBy("ns").count().agg(F.max("count")).first()[0]
    chosen = choose_pivots(centre, some, reach)
    centre = chosen[: _enough(centre, chosen, reach, largest)]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angles = _angles(_matrix(b.column(1)), centre)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(angles.min(axis=1))], names=["__ns", "__cell", "angle"])

    ns_type = dict(vectors.dtypes)["ns"]
    placed = rows.select("ns", "u").mapInArrow(homes, f"__ns {ns_type}, __cell long, angle double")
    sizes = staged(placed.groupBy("__ns", "__cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.max("angle").alias("r")), "cells")
    radii = np.full(len(centre), -np.inf)
    # a row for each pivot
    for r in sizes.groupBy("__cell").agg(F.max("r").alias("r")).collect():
        radii[r["__cell"]] = r["r"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                angles = _angles(_matrix(part.column(2)), centre)
                home = angles.argmin(axis=1)
                goes = (angles <= angles.min(axis=1, keepdims=True) + 2 * reach + SLACK) & (angles <= radii + reach + SLACK)
                goes &= np.arange(len(centre)) < home[:, None]
                goes[np.arange(len(home)), home] = True
                row, cell = np.nonzero(goes)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(angles[row, cell]), pa.array(home[row] == cell)], names=["id", "ns", "u", "cell", "angle", "home"])

    placed = rows.select("id", "ns", "u").mapInArrow(spread, f"id {id_type}, ns {ns_type}, u array<double>, cell long, angle double, home boolean")
    key = F.col("ns").eqNullSafe(F.col("__ns")) & (F.col("cell") == F.col("__cell"))
    rows = placed.join(small(sizes.drop("r")), key).select("ns", "cell", "id", "angle", "home", "u", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    # a home is compared with the parts from its own on, a visitor with all parts
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("*", each)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    place = lambda c: F.when(F.col("home"), c).otherwise(F.col("other"))
    return rows.select("ns", "cell", place(low).alias("a"), place(high).alias("b"), "id", "angle", (F.col("home") & (F.col("part") <= F.col("other"))).alias("home"), "u")


def _pairs_within(x: np.ndarray, at: np.ndarray, y: np.ndarray, to: np.ndarray, threshold: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, cosine) of pairs from the threshold on; both sorted by their angles ``at`` and ``to``."""
    for i in range(0, len(x), ROWS):
        a = slice(i, i + ROWS)
        first, last = np.searchsorted(to, at[a][0] - reach - SLACK), np.searchsorted(to, at[a][-1] + reach + SLACK, side="right")
        for j in range(first, last, ROWS):
            b = slice(j, min(j + ROWS, last))
            cosine = x[a] @ y[b].T
            row, col = np.nonzero(cosine >= threshold)
            yield i + row, j + col, cosine[row, col]


def similar_pairs(vectors: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, cosine): all pairs a < b of one namespace (``ns``) with cosine >= threshold.

    ``vectors`` has id, ns, v; all v of one length. Vectors that are null, zero or hold odd
    components are in no pair.
    """
    id_type, reach = dict(vectors.dtypes)["id"], math.acos(max(-1.0, min(1.0, threshold)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sides, out = [], []
        for home in (True, False):
            side = rows[rows["home"] == home].sort_values("angle")
            u = np.stack(side["u"].to_numpy()) if len(side) else np.zeros((0, 1))
            sides.append((side["id"].to_numpy(), u, side["angle"].to_numpy()))
        (own, x, at), (others, y, to) = sides
        same = bool(rows["a"].iloc[0] == rows["b"].iloc[0])
        if same:
            for i, j, cosine in _pairs_within(x, at, x, at, threshold, reach):
                once = own[i] < own[j]
                out.append((own[i][once], own[j][once], cosine[once]))
        if len(own) and len(others):
            for i, j, cosine in _pairs_within(x, at, y, to, threshold, reach):
                out.append((np.minimum(own[i], others[j]), np.maximum(own[i], others[j]), cosine))
        a, b, cosine = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pd.DataFrame({"a": a, "b": b, "cosine": cosine})

    groups = dealt(vectors, threshold, pivots).groupBy("ns", "cell", "a", "b")
    return groups.applyInPandas(compare, f"a {id_type}, b {id_type}, cosine double")
