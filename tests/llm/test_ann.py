"""The distance ratio alone decides which lists a query asks."""

import numpy as np

from factlake.llm import ann


def test_no_cap_overrules_the_distance_ratio():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(4096, 64))
    graph = ann.Graph(c / np.linalg.norm(c, axis=1, keepdims=True))
    x = (0.01 * rng.normal(size=(8, 64))).astype(np.float32)
    d = np.sqrt(((x[:, None].astype(float) - graph.c[None]) ** 2).sum(axis=2))
    row, lists = ann._probes(graph, x)
    for i in range(len(x)):
        asked, ratio = set(lists[row == i].tolist()), d[i] / d[i].min()
        assert set(np.nonzero(ratio <= 1 + ann.PROBE - 1e-4)[0]) <= asked
        assert set(np.argsort(d[i])[: ann.MIN_PROBES]) <= asked
    assert np.bincount(row).max() > 256


def test_equal_distances_go_by_id(spark):
    """All of them at one distance: the smallest ids, in one list and in parts of it."""
    n = 300
    df = spark.createDataFrame([(i, [float(i == j) for j in range(n)]) for i in range(n)], "vec_id long, embedding array<float>")
    got = ann.search(df, ann.F.col("vec_id") % 100 == 0).collect()
    want = {q: [i for i in range(n) if i != q][:10] for q in (0, 100, 200)}
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == want
    assert len({r.score for r in got}) == 1


def test_ties_against_brute_force():
    """Small whole numbers: many rows at each distance, of which the first count."""
    rng = np.random.default_rng(4)
    p, q = rng.integers(0, 3, (2_000, 6)).astype(float), rng.integers(0, 3, (40, 6)).astype(float)
    at, row, score = ann.nearest_rows(p, q, 11)
    exact = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
    for i in range(len(q)):
        want = np.lexsort((np.arange(len(p)), exact[i]))[:11]
        assert row[at == i].tolist() == want.tolist() and score[at == i].tolist() == exact[i][want].tolist()


def test_queries_are_dealt_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(enumerate(rng.normal(size=(900, 8)).tolist()), "vec_id long, embedding array<float>")
    run = lambda: sorted(map(tuple, ann.search(df, ann.F.col("vec_id") % 10 == 0).collect()))
    whole = run()
    for name, value in (("QUERIES", 7), ("SHARD", 50)):
        monkeypatch.setattr(ann, name, value)
        assert run() == whole


def test_replicas_are_those_of_the_boundary():
    """A vector amid two clusters is in both lists, one in the heart of a cluster in its own only."""
    c = np.array([[0.0, 0], [10, 0], [0.5, 0.5], [0, 10]], np.float32)
    x = np.array([[5.0, 0.2], [0, -1], [9, 0.5]], np.float32)
    row, lists = ann._posting_lists(ann.Graph(c), x)
    got = [set(lists[row == i].tolist()) for i in range(3)]
    assert got[0] >= {1} and len(got[0]) == 2 and got[1] == {0} and got[2] == {1}


def test_clustered_vectors_are_found_in_few_lists(spark, monkeypatch):
    """Recall against brute force where lists outnumber those asked many times."""
    monkeypatch.setattr(ann, "LIST_SIZE", 40)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(300, 32))
    x = (centre[rng.integers(0, 300, 12_000)] + 0.35 * rng.normal(size=(12_000, 32))).astype(np.float32)
    df = spark.createDataFrame(enumerate(x.tolist()), "vec_id long, embedding array<float>")
    got = ann.search(df, ann.F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 12_000, 100):
        d = ((x - x[q]).astype(float) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argpartition(d, 10)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 1200 and hits >= 0.95 * 1200
    graph = ann.Graph(ann.fit(x[:8000], 300))
    assert np.bincount(ann._probes(graph, x[::100])[0]).mean() < 0.2 * 300
