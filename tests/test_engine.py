"""Named behaviours of graphs, lifecycle, exchange and streams."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import changes as c
from factlake.operators import graph as g
from factlake.operators import lifecycle as life
from factlake.operators import lint
from factlake.operators import quality as q
from factlake.operators import ranking as r
from factlake.sources import interchange as x
from factlake.streaming import changes as s

EDGES = [("a", "monitors", "b"), ("b", "uses", "c"), ("c", "uses", "a"), ("b", "uses", "d"), ("e", "uses", "e")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, t, b, None, 1.0) for a, t, b in EDGES], "source_id string, relation_type string, target_id string, scope string, weight double")


def ids(df, *cols):
    return sorted(tuple(row) for row in df.select(*cols).collect())


def test_traverse(spark, edges):
    start = spark.createDataFrame([("a",)], "id string")
    inside, near, visited = g.traverse(edges, start, 1)
    assert ids(inside, "id", "depth") == [("a", 0), ("b", 1)]
    assert len(near.collect()) == 3 and visited.count() == 4


def test_paths_and_cycles(spark, edges):
    assert [p.target_id for p in g.shortest_path(edges, "a", "d").first().path] == ["b", "d"]
    assert g.shortest_path(edges, "a", "a").first().path == []
    assert g.shortest_path(edges, "d", "a").count() == 0
    assert sorted(r.cycle for r in g.cycles(edges, 5).collect()) == [["a", "b", "c"], ["e"]]


def test_components_equal_union_find(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 107), (107, 103), (200, 200)]
    got = dict(ids(g.components(spark.createDataFrame(pairs, "a long, b long")), "node", "component"))
    assert all(got[i] == 0 for i in range(1, 41)) and got[107] == got[103] == 100


def test_scoped_edges_do_not_cross(spark):
    rows = [("a", "t", "b", "x", 1.0), ("a", "t", "b", "y", 1.0), ("a", "t", "z", "x", 1.0)]
    e = spark.createDataFrame(rows, "source_id string, relation_type string, target_id string, scope string, weight double")
    seen = spark.createDataFrame([("a",), ("b",)], "id string")
    assert ids(g.scoped(e, seen, "x"), "source_id", "target_id", "scope") == [("a", "b", "x")]


def test_bm25_counts_repeated_query_terms_once(spark):
    docs = spark.createDataFrame([(1, "redis cache"), (2, "redis redis"), (3, "other"), (4, "")], "id long, content string")
    once, twice = (ids(r.bm25(docs, query, 10).withColumn("score", F.round("score", 9)), "id", "score") for query in ("redis", "Redis redis!"))
    assert once == twice and [i for i, _ in once] == [1, 2]


def test_bm25_many_equals_one_by_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a a b", "c d", "e"])], "id long, content string")
    many = r.bm25_many(docs, spark.createDataFrame([(7, "a c")], "query_id long, query string"), 10)
    single = r.bm25(docs, "a c", 10).withColumn("score", F.round("score", 6))
    assert ids(many, "id", "score") == ids(single, "id", "score")


def test_priors(spark):
    df = spark.createDataFrame([(0, "note", -3.0, 1.5), (90 * 86_400_000, "note", 0.0, 0.5), (10**13, "decision", None, -1.0)], "age long, t string, bias double, conf double")
    got = df.select(F.round(r.decay_prior(F.col("age"), F.col("t"), ["decision"]), 4), r.confidence_prior(F.col("conf")), F.round(r.feedback_prior(F.col("bias")), 4)).collect()
    assert [tuple(x) for x in got] == [(1.0, 1.0, 0.9005), (0.3679, 0.5, 1.0), (1.0, 0.0, 1.0)]


def test_exact_dedup_unites_entities(spark):
    kind = "id long, content string, source_id string, entity_ids array<string>"
    old = spark.createDataFrame([(1, "x", "n", ["a"])], kind)
    new = spark.createDataFrame([(2, "x", "n", ["b"]), (3, "x", "m", ["c"]), (4, "x", None, ["d"])], kind)
    facts, receipts = life.insert(old, new)
    assert ids(facts, "id", "entity_ids") == [(1, ["a", "b"]), (3, ["c"]), (4, ["d"])]
    assert ids(receipts, "id", "stored_id", "merged") == [(2, 1, True), (3, 3, False), (4, 4, False)]


def test_feedback_is_clamped_in_order(spark):
    facts = spark.createDataFrame([(1,)], "id long")
    votes = spark.createDataFrame([(1, i, True) for i in range(7)] + [(1, 9, False)], "fact_id long, at long, helpful boolean")
    assert life.feedback(facts, votes).first().relevance_score == 0.85


def test_consolidation_keeps_newest_or_medoid(spark):
    rows = [(1, "n", [1.0, 0.0]), (2, "n", [1.0, 0.01]), (3, "n", [1.0, 0.02]), (4, "n", [0.0, 1.0]), (5, "m", [1.0, 0.0])]
    got = life.consolidate(spark.createDataFrame(rows, "id long, ns string, v array<double>"), 0.9)
    assert ids(got, "id", "tight", "keep") == [(1, True, False), (2, True, False), (3, True, True)]


def test_handoff_fold(spark):
    events = [("h", 1, 1, "dispatch", "x"), ("h", 2, 2, "accept", "a"), ("h", 3, 3, "accept", "b"), ("h", 50, 4, "accept", "b"), ("h", 51, 5, "return", "a"), ("h", 52, 6, "return", "b"), ("g", 1, 1, "dispatch", "x")]
    got = life.handoff_states(spark.createDataFrame(events, "id string, at long, seq long, action string, actor string"), 60, 20)
    assert ids(got, "id", "state", "holder", "lane") == [("g", "pending", None, "ready"), ("h", "completed", "b", "returned")]


def test_lww(spark):
    kind = "id long, content string, source_id string, updated_at long"
    local = spark.createDataFrame([(1, "a", "n", 5), (2, "b", "n", 5)], kind)
    new = spark.createDataFrame([(1, "a2", "n", 6), (2, "b2", "n", 5), (3, "b", "n", 9), (4, "c", "n", 1)], kind)
    merged = life.lww_merge(local, new)
    assert ids(merged, "id", "content") == [(1, "a2"), (2, "b"), (4, "c")]
    assert ids(life.lww_merge(merged, new), "id", "content") == [(1, "a2"), (2, "b"), (4, "c")]


def test_lint_duplicates(spark):
    names = [("1", "Redis Cluster Manager", "t"), ("2", "redis cluster managers", "t"), ("3", "Postgres", "t"), ("4", "Redis Cluster Manager", "u")]
    df = spark.createDataFrame(names, "id string, name string, entity_type string")
    assert ids(lint.duplicates(df, ratio=0.8, similarity=0.8), "a_id", "b_id") == [("1", "2")]


def test_envelope_preflight(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    lines = x.envelope({"fact": df}, 7)
    assert x.preflight(lines)["fact_count"] == 2
    with pytest.raises(ValueError, match="cursor"):
        x.preflight(lines.where("part < 99"))
    with pytest.raises(ValueError, match="header"):
        x.preflight(lines.where("part > 0"))


def test_import_counts_bad_lines(spark):
    lines = spark.createDataFrame([('{"schema_version":2}',), ('{"type":"fact","data":{"id":1}}',), ("not json",), ("",)], "line string")
    tables, errors = x.parse_lines(lines, {"fact": "id:long"})
    assert ids(tables["fact"], "id") == [(1,)] and errors.first().errors == 1


def test_backup_notices_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    x.backup({"t": df}, str(tmp_path / "b"))
    assert ids(x.restore(spark, str(tmp_path / "b"))["t"], "id", "name") == [(1, "a")]
    spark.createDataFrame([(1, "z")], "id long, name string").write.mode("overwrite").parquet(str(tmp_path / "b/t"))
    with pytest.raises(ValueError, match="manifest"):
        x.restore(spark, str(tmp_path / "b"))


CHANGE = "seq long, actor_id string, id long, operation string, revision long, body string"


def test_replica_rejects_two_bodies(spark):
    a = spark.createDataFrame([(1, "x", 1, "upsert", 1, "b")], CHANGE)
    b = spark.createDataFrame([(2, "x", 1, "upsert", 1, "other")], CHANGE)
    with pytest.raises(ValueError, match="two bodies"):
        c.apply_batch(a, b)
    with pytest.raises(ValueError, match="grow"):
        c.check_batch(a, 1)


def test_commands_replay_and_conflict(spark):
    log = spark.createDataFrame([("c", 1, "a", "p"), ("c", 2, "a", "p"), ("c", 3, "a", "q")], "command_id string, at long, actor string, payload string")
    receipts, conflicts = c.commands(log)
    assert receipts.first().replays == 2 and ids(conflicts, "at") == [(3,)]


def test_stream_follows_and_resumes(spark, tmp_path):
    """Each round has a new replica object over the same folder, as after a restart."""
    log, mark, home = (str(tmp_path / x) for x in ("log", "mark", "home"))
    for batch in ([(1, "x", 1, "upsert", 1, "a"), (2, "x", 2, "upsert", 1, "b")], [(3, "x", 1, "delete", 2, None)]):
        spark.createDataFrame(batch, CHANGE).write.mode("append").parquet(log)
        replica = s.Replica(spark, CHANGE, home)
        s.follow(spark.readStream.schema(CHANGE).parquet(log), replica, mark).awaitTermination()
    assert ids(c.status(replica.table()), "live", "tombstones", "cursor") == [(1, 1, 3)]
    replica.compact()
    replica.apply(spark.createDataFrame([(4, "x", 2, "upsert", 2, "c")], CHANGE), 7)
    replica.apply(spark.createDataFrame([(4, "x", 2, "upsert", 2, "c")], CHANGE), 7)
    assert ids(s.Replica(spark, CHANGE, home).table(), "id", "body") == [(1, None), (2, "c")]


def test_long_paths_and_cycles_are_found(spark):
    edges = spark.createDataFrame([(f"n{i:02}", "next", f"n{(i + 1) % 14:02}") for i in range(14)], "source_id string, relation_type string, target_id string")
    assert len(g.shortest_path(edges, "n00", "n12").first().path) == 12
    assert [len(r.cycle) for r in g.cycles(edges).collect()] == [14]


def test_session_memory_calls(spark):
    from factlake.api import Memory

    facts = spark.createDataFrame(
        [(1, "we paid $12.50 on 2024-01-02", "note", "a", "x", 0.5, 1, None, None, None, False), (2, "three days of work", "note", "b", "x", 0.9, 2, None, None, None, True), (3, "old", "note", "a", "x", 0.1, 0, None, 5, 2, False)],
        "id long, content string, fact_type string, entity string, source_id string, source_confidence double, created_at long, observed_at long, superseded_at long, superseded_by long, pinned boolean",
    ).withColumn("observed_at", F.col("created_at"))
    entities = spark.createDataFrame([("a", "Ann", "person", ["t"], 1), ("b", "Bob", "person", ["t"], 1)], "id string, name string, entity_type string, tags array<string>, updated_at long")
    bridge = facts.select(F.col("id").alias("fact_id"), F.col("entity").alias("entity_id"))
    m = Memory(facts, entities, bridge, spark.createDataFrame([("a", "knows", "b", None, 1.0)], "source_id string, relation_type string, target_id string, scope string, weight double"))
    assert m.aggregate("count").first().n == 2 and m.aggregate("sum_currency").first().total == 1250
    assert m.aggregate("count_distinct_dates").first().n == 1 and m.aggregate("sum_duration").first().days == 3
    assert [r.day for r in m.aggregate("timeline").collect()] == ["2024-01-02"] and m.aggregate("by_entity").count() == 2
    assert ids(m.search("paid work", 5), "id") == [(1,), (2,)]
    asked = spark.createDataFrame([(9, "work days")], "query_id long, query string")
    assert ids(m.search_many(asked), "query_id", "id") == [(9, 2)]
    assert ids(m.search_with_archive("old", facts.where("id = 3")), "id", "tier") == [(3, 1)]
    assert ids(m.fact_pin(facts.where("id = 1").select("id")).where("pinned"), "id") == [(1,), (2,)]
    assert m.fact_edit(spark.createDataFrame([(1, "old")], "id long, content string"))[1].first().existing_id == 3
    assert m.entity_find(spark.createDataFrame([("ann",), ("Bobb",)], "wanted string")).count() == 2
    left = m.entity_delete(spark.createDataFrame([("ANN",)], "wanted string"))
    assert (left["entities"].count(), left["relations"].count(), left["bridge"].count()) == (1, 0, 1)
    with pytest.raises(ValueError):
        m.aggregate("nothing")


def test_review_logs_and_golden_sets(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"idx": 1, "content": "a"}\n\nnot json\n{"idx": 2, "content": "b"}\n')
    assert ids(x.read_pending(spark, str(tmp_path / "log.jsonl")), "idx") == [(1,), (2,)]
    assert x.read_pending(spark, str(tmp_path / "missing.jsonl")).count() == 0
    (tmp_path / "gold.jsonl").write_text('{"query": "q", "expected": ["1"]}\n{"query": "r", "expected": [], "k": 3}\n')
    assert ids(x.read_golden(spark, str(tmp_path / "gold.jsonl")), "query", "k") == [("q", 10), ("r", 3)]


def test_watch_reads_new_files_once(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    for name in ("a.md", "b.md"):
        (tmp_path / "in" / name).write_text(f"# {name}")
        s.watch(spark, str(tmp_path / "in"), lambda df, i: seen.extend(r.content for r in df.collect()), str(tmp_path / "w")).awaitTermination()
    assert seen == ["# a.md", "# b.md"]


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "wiki/people").mkdir(parents=True)
    (tmp_path / "wiki/people/al.md").write_text("# Al\n## Notes\nhi")
    (tmp_path / "wiki/skip.txt").write_text("no")
    rows = x.markdown_files(spark, str(tmp_path / "wiki"))
    assert ids(rows, "path") == [("people/al.md",)]


def test_retrieval_quality(spark):
    runs = spark.createDataFrame([(1, 10, False, 1), (1, 11, True, 2), (2, 10, True, 1), (3, 12, False, 1)], "query_id long, id long, relevant boolean, rank int")
    got = q.recall_mrr(runs).first()
    assert (round(got.r1, 4), round(got.r5, 4), got.mrr) == (0.3333, 0.6667, 0.5)
