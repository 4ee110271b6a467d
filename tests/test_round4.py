"""What the findings of round 4 asked for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators import maintained as m
from factlake.operators import lexjoin, lint, quality, ranking, service, similarity
from factlake.operators.maintained import Maintained, View
from factlake.streaming import leases


def test_largest_of_a_key_whose_kept_values_are_gone(spark, monkeypatch):
    """more values than are kept were taken back; only the lost keys are counted again."""
    monkeypatch.setattr(m, "KEEP", 3)
    view = View("v", ("k",), ("n",), lambda df: df.select("k", F.lit(1).cast("long").alias("n"), "t"), "t")
    frame = lambda rows: spark.createDataFrame(list(rows), "k string, t long")
    rows = [(k, t) for k in ("a", "b", None) for t in range(10)] + [("c", None)]
    counts = Maintained(spark, view)
    counts.apply(0, after=frame(rows))
    counts.fold(0)
    gone = [(k, t) for k, t in rows if k in ("a", None) and t is not None and t >= 5] + [("b", 9)]
    counts.apply(1, before=frame(gone))
    left = [r for r in rows if r not in gone]
    assert dict(map(tuple, counts.largest(table=frame(left)).collect())) == {"a": 4, "b": 8, None: 4}
    with pytest.raises(m.RecountNeeded):
        counts.largest()
    whole = Maintained(spark, View("w", (), ("n",), lambda df: df.select(F.lit(1).cast("long").alias("n"), "t"), "t"))
    whole.apply(0, after=frame(rows))
    whole.fold(0)
    whole.apply(1, before=frame([r for r in rows if r[1] is not None and r[1] >= 2]))
    assert [r[0] for r in whole.largest(table=frame([r for r in rows if r[1] is None or r[1] < 2])).collect()] == [1]


def test_one_limit_for_both_tables_of_receipts(spark):
    """the first table's due rows beyond the limit stay, and none is left for the second."""
    first, second = (spark.range(a, a + 12).select("id", F.col("id").alias("retain_until")) for a in (0, 100))
    a, b = service.pruned(first, second, 200, 5)
    assert sorted(r["id"] for r in a.collect()) == list(range(5, 12)) and b.count() == 12
    a, b = service.pruned(first, second, 200, 15)
    assert a.count() == 0 and sorted(r["id"] for r in b.collect()) == list(range(103, 112))


@pytest.mark.parametrize("block, part", [(8192, 20_000), (3, 7)])
def test_retrieval_by_blocks(spark, block, part):
    """Pairs are scored in matrices, none is a row; ties, odd vectors and missing ids as by SQL."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x[20:40] = x[20]  # equal scores
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 5, 1), (102, [1.0], 2), (103, [None] + [1.0] * 4, 0), (104, [float("nan")] * 5, 1), (None, [1.0] * 5, 2), (105, [], 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    queries = df.where("id % 10 = 0 OR id >= 100 OR id IS NULL").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("ql"))
    got = quality.retrieve(queries, df, 6, block, part)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    pairs = df.crossJoin(queries).where("id <> query_id").withColumn("score", F.round(ranking.cosine(F.col("v"), F.col("q")), 6))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 6")
    key = ["query_id", "id", "rank", "label", "ql", F.col("score").cast("string")]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    names = df.select(F.concat(F.lit("n"), "id").alias("id"), "v")  # ids of another type, and no row at all
    asked = names.limit(2).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert quality.retrieve(asked, names, 3, block, part).count() == 6
    assert quality.retrieve(asked, names.where("false"), 3, block, part).count() == 0


def test_vectors_without_structure_are_copied_few_times(spark):
    """pivots that do not prune would send a row to half of all cells."""
    n = 3000
    x = np.random.default_rng(6).normal(size=(n, 32))
    x[n // 2 :] = x[: n // 2] + 0.05 * x[n // 2 :]
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, v.tolist()) for i, v in enumerate(x)], "id long, ns int, v array<double>")
    assert similarity.dealt(df, 0.85).count() <= similarity.COPIES * n
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ns = np.array([i % 3 if i % 5 else -1 for i in range(n)])
    want = np.argwhere(np.triu((u @ u.T >= 0.85) & (ns[:, None] == ns), 1))
    got = [(r.a, r.b) for r in similarity.similar_pairs(df, 0.85).collect()]
    assert sorted(got) == sorted(map(tuple, want.tolist())) and len(got) > 100


@pytest.mark.parametrize("pairs", [lint.PAIRS, (0,) * 4, (10**9,)])
def test_duplicates_of_numbered_names(spark, monkeypatch, pairs):
    """names whose trigrams are nearly all common meet few others, and none is missed."""
    monkeypatch.setattr(lint, "PAIRS", pairs)
    rng = random.Random(2)
    rows = [(f"c{i}", f"Customer#{i:09d}", "c") for i in rng.sample(range(5000), 400)] + [(f"s{i}", f"Customer#{i:09d}", None if i % 9 == 0 else "s") for i in range(30)]
    rows += [(f"p{i}", f"red {'long ' * (i % 3)}widget {'x' * (i % 7)}", "p") for i in range(40)] + [("e1", "", "c"), ("e2", None, "c")]
    df = spark.createDataFrame(rows, "id string, name string, entity_type string")
    grams = lambda s: {f"  {s.lower()}  "[i : i + 3] for i in range(len(s) + 2)}
    low = {}
    for i, name, kind in rows:
        if name is not None and kind is not None:
            low[kind, name.lower()] = min(i, low.get((kind, name.lower()), i))
    names = [(i, kind, grams(name)) for (kind, name), i in low.items()]
    for ratio, least in ((0.8, 0.8), (0.9, 0.9), (0.5, 0.4)):
        want = set()
        for i, kind, g in names:
            for j, other, h in names:
                if kind == other and i < j and len(g & h) >= 4 and min(len(g), len(h)) >= ratio * max(len(g), len(h)) and len(g & h) / len(g | h) > least:
                    want.add((i, j))
        got = [(r["a_id"], r["b_id"]) for r in lint.duplicates(df, ratio=ratio, similarity=least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert want


def test_keys_of_numbered_names_are_rare(spark):
    """with one trigram a key every name would meet hundreds of others."""
    plans = lint._plans({"c": {20: 900_000, 19: 80_000}}, 4, 0.8, 0.8)
    assert {(low, high): (prefix, size) for low, high, _, _, prefix, size in plans["c", 20]} == {(20, 20): (7, 5), (19, 20): (6, 4)}


@pytest.mark.parametrize("common, grid", [(0.01, 3), (2.0, 1)])
def test_every_text_asks(spark, monkeypatch, common, grid):
    """pairs are scored in cells, none is a row, with the scores of the join of terms."""
    for name, value in (("COMMON", common), ("GRID", grid), ("LEAST", 5), ("TILE", 7)):
        monkeypatch.setattr(lexjoin, name, value)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(1, 40)]) for _ in range(rng.randint(0, 12))), rng.choice(["a", "b", "", None])) for i in range(90)]
    docs = spark.createDataFrame([*rows, (90, None, "a"), (91, "", None)], "id long, content string, source_id string")
    asked = docs.select(F.col("id").alias("query_id"), F.col("content").alias("query"), "source_id").where("query IS NOT NULL")
    for options in ({"same": "source_id", "but_own": True}, {"same": "source_id"}, {"but_own": True}):
        got = lexjoin.bm25_join(docs, asked, 4, **options)
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, ranking.bm25_many(docs, asked, 4, **options).select("query_id", "id", "score", "rank").collect()))
    assert lexjoin.bm25_join(docs.where("false"), asked, 4).count() == 0 and lexjoin.bm25_join(docs, asked.where("false"), 4).count() == 0


def test_a_handoff_calls_its_state_few_times(monkeypatch):
    """messages to the state store do not grow with the events of a handoff."""
    calls = []

    class State:
        held = empty = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("update", "put", "appendList"):
                    self.held = [*(self.held or []), *args[0]] if name == "appendList" else args[0]
                if name == "clear":
                    self.held = None
                return self.empty if self.held is None else self.held

            return call

    class Handle(State):
        def getValueState(self, name, schema):  # noqa: N802
            return State()

        def getListState(self, name, schema):  # noqa: N802
            out = State()
            out.empty = ()
            return out

    class Times:
        at = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    machine, times = leases.LeaseMachine(1000, 10), Times()
    machine.init(Handle())
    events = [{"at": i, "seq": i, "action": "dispatch" if i == 0 else "accept" if i == 1 else "heartbeat", "actor": "a", "expected": None} for i in range(200)]
    for part in (events[::2], events[1::2], events[::3]):
        calls.clear()
        rows = list(machine.handleInputRows((7,), iter(part), times))
        assert len(calls) <= 6
    assert rows[0]["revision"] == 200 and rows[0]["expires"] == 1199 and rows[0]["events"] == 200
    times.at = 150
    rows = list(machine.handleInputRows((7,), iter([]), times))
    assert rows[0]["revision"] == 200 and machine.base.held[2] == 150 and len(machine.later.held) == 50
