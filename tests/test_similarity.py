"""The exact similarity join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.operators import similarity


def frame(spark, x, spaces=("a", None)):
    return spark.createDataFrame([(i, spaces[i % len(spaces)], v.tolist()) for i, v in enumerate(x)], "id long, ns string, v array<double>")


def all_pairs(x, threshold, spaces=2):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a % spaces == b % spaces}


def clustered(n, groups, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.3])
def test_equal_to_all_pairs(spark, threshold, monkeypatch):
    x = np.concatenate([clustered(500, 25), np.random.default_rng(2).normal(size=(100, 24))])
    got = [(r.a, r.b) for r in similarity.similar_pairs(frame(spark, x), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, threshold)
    monkeypatch.setattr(similarity, "PART", 9)  # cells dealt in parts
    got = [(r.a, r.b) for r in similarity.similar_pairs(frame(spark, x), threshold, pivots=4).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, threshold)


def test_copies_and_odd_vectors(spark):
    x = clustered(30, 3)
    rows = [(i, "a", v.tolist()) for i, v in enumerate(np.concatenate([x, x, x[:5] * 3.0]))]
    rows += [(100, "a", [0.0] * 24), (101, "a", None), (102, "a", [float("nan")] * 24), (103, "a", [None] * 24)]
    df = spark.createDataFrame(rows, "id long, ns string, v array<double>")
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.999).collect()}
    assert got >= {(i, i + 30) for i in range(30)} | {(i, i + 60) for i in range(5)} and max(b for _, b in got) < 65
    assert similarity.similar_pairs(df.where("false"), 0.9).count() == 0


def test_few_pairs_of_clustered_vectors_are_compared(spark):
    n = 4000
    x = clustered(n, 120, dims=32, seed=3)
    rows = similarity.dealt(frame(spark, x, ("a",)), 0.9).groupBy("ns", "cell", "a", "b").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("o")).collect()
    compared = sum(r.h * (r.h - 1) / 2 * (r.a == r.b) + r.h * r.o for r in rows)
    assert compared < 0.05 * n * (n - 1) / 2
