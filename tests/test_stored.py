"""The stored index, strong components, leases on a stream, the change feed, and batches of writes."""

import glob
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators import lifecycle as life
from factlake.operators import postings, scc
from factlake.operators import ranking as r
from factlake.operators import writes as w
from factlake.sources import feed
from factlake.streaming import leases

# ---- index ----------------------------------------------------------------------


def texts(spark, n=400):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(2, 60)]) for _ in range(rng.randint(0, 40))), f"ns{i % 3}" if i % 7 else None) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, "", "ns1")], "id long, content string, source_id string")


def best(df, k):
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return sorted(map(tuple, df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank").collect()))


def test_index_equals_the_scan(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)  # many blocks, so that most are passed over
    docs = texts(spark).cache()
    queries = spark.createDataFrame([(0, "w1 w50 w58"), (1, "w0"), (2, "nothing here"), (3, "w59 w57 w2 w2"), (4, "")], "query_id long, query string")
    stored = postings.Index(spark)
    stored.add(docs.where("id % 4 < 2"), tag="source_id")
    stored.add(docs.where("id % 4 >= 2"), tag="source_id")
    assert best(stored.search_many(queries, 5), 5) == best(r.bm25_many(docs, queries, 5), 5)
    own = docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query"), "source_id")
    assert best(stored.search_many(own, 3, same="source_id", but_own=True), 3) == best(r.bm25_many(docs, own, 3, same="source_id", but_own=True), 3)
    for length in (None, 256.0):  # a fixed average length stands in for the corpus's
        got = sorted(map(tuple, stored.search("w1 w50 w58", 10, docs, average=length).collect()))
        assert got == sorted(map(tuple, r.bm25(docs, "w1 w50 w58", 10, avgdl=length).select("id", "score", "rank").collect()))
    # removed documents count nowhere, before a merge and after it
    stored.remove(docs.where("id % 3 = 0").select("id"))
    left = docs.where("id % 3 <> 0")
    assert best(stored.search_many(queries, 5), 5) == best(r.bm25_many(left, queries, 5), 5)
    stored.merge()
    assert len(stored.state().segments) == 1 and not stored.state().gone and stored.state().n == left.count()
    assert best(stored.search_many(queries, 5), 5) == best(r.bm25_many(left, queries, 5), 5)
    stored.add(docs.where("id % 3 = 0"))
    assert best(stored.search_many(queries, 5), 5) == best(r.bm25_many(docs, queries, 5), 5)


def test_a_search_opens_few_files_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    docs, stored = texts(spark), postings.Index(spark)
    stored.add(docs)
    every = stored.postings()
    mine = stored.postings(["w1", "w58"])
    assert len(mine.inputFiles()) <= len(every.inputFiles())
    plan = mine.select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    read = {b for b in glob.glob(f"{stored.path}/segment-0/postings/bucket=*")}
    assert len(read) > 10 and mine.select("bucket").distinct().count() <= 2
    assert mine.count() < 0.2 * every.count()


def test_an_index_of_nothing(spark):
    docs, stored = texts(spark), postings.Index(spark)
    queries = spark.createDataFrame([(0, "w1")], "query_id long, query string")
    assert stored.search_many(queries, 5).count() == 0
    stored.add(docs.where("false"))
    assert stored.search_many(queries, 5).count() == 0 and stored.search("w1", 5).count() == 0


def test_a_write_that_fails_changes_nothing(spark, monkeypatch):
    docs, stored = texts(spark), postings.Index(spark)
    stored.add(docs.where("id < 100"))
    before = stored.state()
    monkeypatch.setattr(stored, "_commit", lambda state: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        stored.add(docs.where("id >= 100"))
    assert stored.state() == before and stored.docs().count() == 100


# ---- strong components --------------------------------------------------------------


def reaching(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[a] = seen
    return found


@pytest.mark.parametrize("seed, n, m", [(1, 30, 36), (2, 40, 60)])
def test_strong_components(spark, seed, n, m):
    """Random graphs, with loops, double edges, nested and separate cycles."""
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100), (101, 100), (200, 200), (300, 301)]
    df = spark.createDataFrame([(f"n{a:03d}", "t", f"n{b:03d}") for a, b in edges], "source_id string, relation_type string, target_id string")
    ways = reaching(edges)
    want = {}
    for a in ways:
        same = {b for b in ways[a] if a in ways.get(b, ())}
        if same:
            want[f"n{a:03d}"] = (f"n{min(same):03d}", len(same))
    assert {x.id: (x.component, x.size) for x in scc.strong_components(df).collect()} == want
    rest = [(x.a, x.b) for x in scc.condensed(df).collect()]
    assert all(a not in to for a, to in reaching(rest).items())
    assert scc.strong_components(df.where("false")).count() == 0


# ---- leases ---------------------------------------------------------------------------

EVENTS = "id long, at long, seq long, action string, actor string, expected int, ts timestamp"
HOUR = 3_600_000


def stream(spark, path, rows):
    df = spark.createDataFrame(rows, "id long, at long, seq long, action string, actor string, expected int").withColumn("ts", F.timestamp_millis("at"))
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_leases_with_late_events_restarts_and_timers(spark, tmp_path):
    path, done, table = str(tmp_path / "log"), str(tmp_path / "done"), leases.LeaseTable(spark, str(tmp_path / "table"))
    first = [
        (1, 1 * HOUR, 1, "dispatch", "x", None), (1, 2 * HOUR, 2, "accept", "a", None), (2, 1 * HOUR, 3, "dispatch", "x", None),
        (2, 3 * HOUR, 6, "return", "b", None), (3, 1 * HOUR, 7, "dispatch", "x", 5), (3, 1 * HOUR, 8, "dispatch", "x", 0),
    ]
    leases.follow_leases(stream(spark, path, first), table, done, 5 * HOUR, "2 hours").awaitTermination()
    got = {x.id: (x.state, x.holder, x.revision) for x in table.table(3 * HOUR).collect()}
    assert got == {1: ("accepted", "a", 2), 2: ("pending", None, 1), 3: ("pending", None, 1)}
    # the accept before the return comes late, the accept of 1 again; then time passes, and the lease of 1 ends
    more = [(2, 2 * HOUR, 5, "accept", "b", None), (1, 2 * HOUR, 2, "accept", "a", None)]
    leases.follow_leases(stream(spark, path, more), table, done, 5 * HOUR, "2 hours").awaitTermination()
    got = {x.id: (x.state, x.holder, x.revision, x.lane) for x in table.table(4 * HOUR).collect()}
    assert got[1] == ("accepted", "a", 2, "in_progress") and got[2] == ("completed", "b", 3, "returned")
    for at in (20, 21):  # the watermark moves after the first, timers fire with the second
        leases.follow_leases(stream(spark, path, [(9, at * HOUR, at, "dispatch", "x", None)]), table, done, 5 * HOUR, "2 hours").awaitTermination()
    rows = spark.read.parquet(table.path)
    assert rows.where("id = 1 AND overdue").count() == 1
    assert {x.id: x.lane for x in table.table(21 * HOUR).collect()}[1] == "attention"
    # an event behind the watermark is dropped, and what is folded stays as it was
    leases.follow_leases(stream(spark, path, [(1, 2 * HOUR, 99, "return", "a", None)]), table, done, 5 * HOUR, "2 hours").awaitTermination()
    assert {x.id: x.state for x in table.table(21 * HOUR).collect()}[1] == "accepted"


# ---- change feed ------------------------------------------------------------------------


def test_feed_batches_and_epochs(spark, tmp_path):
    spark.dataSource.register(feed.ChangeFeed)
    path, done, out = str(tmp_path / "log"), str(tmp_path / "done"), str(tmp_path / "out")
    rows = spark.range(1000).select(F.col("id").alias("seq"), F.lit("a").alias("actor_id"), "id", F.lit("upsert").alias("operation"), F.lit(1).cast("long").alias("revision"), F.lit("b").alias("body"))
    feed.append_log(rows.where("seq < 600"), path, 1)
    assert spark.read.format("changefeed").option("path", path).option("chunk", 50).load().count() == 600
    assert spark.read.format("changefeed").option("path", path).option("after", 590).load().count() == 9

    def follow(**options):
        reader = spark.readStream.format("changefeed").option("path", path).option("chunk", 70)
        for k, x in options.items():
            reader = reader.option(k, x)
        take = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        reader.load().writeStream.foreachBatch(take).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
        return sorted(x.seq for x in spark.read.parquet(out).collect())

    assert follow() == list(range(600))
    feed.append_log(rows.where("seq >= 600"), path, 1)
    assert follow() == list(range(1000))
    assert follow() == list(range(1000))
    feed.append_log(rows.where("seq < 30"), path, 2)
    with pytest.raises(StreamingQueryException, match="epoch 2"):
        follow()
    assert follow(reset="true") == sorted([*range(1000), *range(30)])


def test_feed_ranges_are_bounded():
    assert [(x.after, x.upto) for x in feed.ranges(1, -1, 9, 4)] == [(-1, 3), (3, 7), (7, 9)]
    assert feed.ranges(1, 9, 9, 4) == []


def test_feed_batches_of_a_running_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(100).select(F.col("id").alias("seq"), F.lit("a").alias("actor_id"), "id", F.lit("upsert").alias("operation"), F.lit(1).cast("long").alias("revision"), F.lit("b").alias("body"))
    feed.append_log(rows, path, 1)
    reader = feed.FeedStream({"path": path, "maxChanges": "40"})
    at, sizes = reader.initialOffset(), []
    for _ in range(4):
        end = reader.latestOffset()
        sizes.append(sum(b.num_rows for x in reader.partitions(at, end) for b in reader.read(x)))
        at = end
    assert sizes == [40, 40, 20, 0]


# ---- writes -----------------------------------------------------------------------------


def test_patches_of_one_batch(spark):
    facts = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", "n")], "id long, content string, source_id string")
    changes = spark.createDataFrame([(1, 1, "x"), (2, 2, "x"), (3, 3, "y"), (3, 4, "z"), (4, 5, "a")], "id long, seq int, content string")
    done, errors = w.patch(facts, changes)
    assert {x.id: x.content for x in done.collect()} == {1: "x", 2: "b", 3: "z", 4: "a"}
    assert [tuple(x) for x in errors.collect()] == [(2, 1)]
    # what an error leaves in place stands in the way of a further change
    changes = spark.createDataFrame([(1, 1, "c"), (2, 2, "a")], "id long, seq int, content string")
    done, errors = w.patch(facts, changes)
    assert {x.id: x.content for x in done.collect()} == {1: "a", 2: "b", 3: "c", 4: "d"}
    assert {tuple(x) for x in errors.collect()} == {(1, 3), (2, 1)}


def test_renames_of_one_batch(spark):
    entities = spark.createDataFrame([("e1", "Bob", ["robert"], 1), ("e2", "Ann", None, 1), ("e3", "Eve", [], 1)], "id string, name string, aliases array<string>, updated_at long")
    edits = spark.createDataFrame([("e2", 1, "ROBERT"), ("e3", 1, "bob")], "id string, expected_at long, name string")
    done, errors = w.update_entities(entities, edits, 2)
    assert {x.id: x.name for x in done.collect()} == {"e1": "Bob", "e2": "Ann", "e3": "Eve"}
    assert {(x.id, x.existing_id) for x in errors.collect()} == {("e2", "e1"), ("e3", "e1")}
    edits = spark.createDataFrame([("e1", 1, "BOB"), ("e2", 1, "new"), ("e3", 1, "New"), ("e3", 0, None)], "id string, expected_at long, name string")
    done, errors = w.update_entities(entities, edits, 2)
    assert {x.id: x.name for x in done.collect()} == {"e1": "BOB", "e2": "new", "e3": "Eve"}
    assert {(x.id, x.existing_id) for x in errors.collect()} == {("e3", "e2"), ("e3", None)}


def test_new_rulings_supersede_what_shares_an_entity(spark):
    schema = "id long, content string, fact_type string, entity_ids array<string>, source_id string, created_at long, superseded_at long, superseded_by long"
    old = [(1, "a", "decision", ["k"], None, 10, None, None), (2, "b", "decision", ["e"], None, 50, None, None), (3, "c", "decision", ["z"], None, 1, None, None), (4, "d", "decision", ["z"], None, 2, None, None)]
    new = [(5, "f", "decision", ["k", "e"], None, 20, None, None), (6, "g", "decision", ["e"], None, 30, None, None), (7, "h", "note", ["z"], None, 40, None, None), (8, "i", "decision", ["e"], "n", 40, None, None)]
    facts = spark.createDataFrame(old + new, schema)
    done = life.supersede_by_new(facts, facts.where("id >= 5"), ["decision"])
    assert {x.id: x.superseded_by for x in done.collect()} == {1: 5, 2: 5, 3: None, 4: None, 5: 6, 6: None, 7: None, 8: None}
