"""Tables and counts that batches change in place, against plain recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import lifecycle as life
from factlake.operators import maintained as m
from factlake.operators.keyed import KeyedTable
from factlake.operators.maintained import Maintained, RecountNeeded, View
from factlake.operators.stored import FactStore
from factlake.sources import feed
from factlake.streaming.maintained import FollowedView


def replaced(old, new):
    return old.join(new.select("id"), "id", "left_anti").unionByName(new), None


def pairs(spark, rows):
    return spark.createDataFrame(list(rows), "id long, v long")


def test_keyed_table_equals_a_dictionary(spark):
    rng, want = random.Random(3), {}
    table = KeyedTable(spark, ["id"], "id long, v long", most=20)
    assert table.upsert(pairs(spark, []), replaced)[0].count() == 0
    for step, size in enumerate((60, 5, 40)):
        batch = {rng.randrange(-90, 90): step for _ in range(size)}
        table, _ = table.upsert(pairs(spark, batch.items()), replaced)
        want |= batch
        assert dict(map(tuple, table.rows().collect())) == want and table.count() == len(want)
        assert max(b.n for b in table.buckets) <= 20 and len({b.bits for b in table.buckets}) == len(table.buckets)
    again = table.at(table.save())
    assert dict(map(tuple, again.rows().collect())) == want
    keys = spark.createDataFrame([(k,) for k in [*list(want)[:3], 12345]], "id long")
    assert sorted(r["id"] for r in again.candidates(keys).collect()) == sorted(list(want)[:3])


def test_a_small_batch_reads_no_more_from_a_larger_table(spark):
    opened = []
    for n in (1000, 10_000):
        table, _ = KeyedTable(spark, ["id"], "id long, v long", most=200).upsert(spark.range(n).selectExpr("id", "0L AS v"), replaced)
        small, _ = table.upsert(pairs(spark, [(5, 1), (17, 1), (n + 1, 1)]), replaced)
        assert small.count() == n + 1 and small.rows().where("v = 1").count() == 3
        assert table.rows().where("v = 1").count() == 0  # the table before is as it was
        opened.append(small.opened)
    assert max(opened) <= 3 * 200


FACT = "id long, content string, source_id string, entity_ids array<string>, updated_at long"


def facts(rng, ids):
    return [(i, rng.choice(["a", "b", "", None, f"text {i}", f"text {i // 2}"]), rng.choice([None, "x", "y"]), rng.sample(["e1", "e2", "e3"], rng.randint(0, 3)), rng.randrange(5)) for i in ids]


def plain(df):
    return sorted(((r["id"], r["content"], r["source_id"], tuple(sorted(set(r["entity_ids"] or []))), r["updated_at"]) for r in df.collect()), key=repr)


def test_store_inserts_as_the_whole_table_would(spark):
    rng, store, whole = random.Random(8), FactStore(spark, FACT, most=16), spark.createDataFrame([], FACT)
    for lo in (0, 30, 45):
        batch = spark.createDataFrame(facts(rng, range(lo, lo + 15 if lo else 30)), FACT).withColumn("ns", F.lit("clashing"))
        # a null content never equals another in the rule for whole tables, so it is left to the next test
        batch = batch.where("content IS NOT NULL").cache()
        whole, want = life.insert(whole, batch.drop("ns"))
        got = store.insert(batch)
        whole = whole.cache()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert plain(store.rows()) == plain(whole)
    assert plain(FactStore(spark, FACT, store.path, most=16).rows()) == plain(whole)  # another process
    with pytest.raises(ValueError, match="one fact"):
        store.insert(spark.createDataFrame([(0, "quite new", None, [], 0)], FACT))
    with pytest.raises(ValueError, match="has an id"):
        store.insert(spark.createDataFrame([(None, "x", None, [], 0)], FACT))


def test_null_contents_repeated_rows_and_empty_batches(spark):
    store = FactStore(spark, FACT)
    assert store.insert(spark.createDataFrame([], FACT)).count() == 0 and store.rows().count() == 0
    row = (1, None, None, ["e1"], 0)
    store.insert(spark.createDataFrame([row, row, (2, None, None, None, 0), (3, None, "x", [], 0)], FACT))
    assert [(r["id"], r["entity_ids"]) for r in store.rows().orderBy("id").collect()] == [(1, ["e1"]), (3, [])]


def test_store_merges_as_the_whole_table_would(spark):
    rng, store, whole = random.Random(4), FactStore(spark, FACT, most=16), spark.createDataFrame([], FACT)
    for ids in (range(30), range(10, 40), range(0, 40, 3)):
        batch = spark.createDataFrame([(i, f"text {rng.randrange(60)}", None, [], rng.randrange(6)) for i in ids], FACT).cache()
        whole = life.lww_merge(whole, batch).cache()
        store.merge(batch)
        assert plain(store.rows()) == plain(whole)
        held = store.contents.rows().select("id", "ns", "digest").collect()
        assert sorted(map(tuple, held)) == sorted((r["id"], "\0", r["d"]) for r in whole.select("id", F.sha2("content", 256).alias("d")).collect())


def test_a_write_that_fails_changes_nothing(spark, monkeypatch):
    store = FactStore(spark, FACT)
    store.insert(spark.createDataFrame([(1, "a", None, [], 0)], FACT))
    monkeypatch.setattr(store, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.insert(spark.createDataFrame([(2, "b", None, [], 0)], FACT))
    after = FactStore(spark, FACT, store.path)
    assert after.rows().count() == 1
    after.insert(spark.createDataFrame([(2, "b", None, [], 0)], FACT))
    assert after.rows().count() == 2


def test_counts_follow_inserts_changes_and_deletes(spark, monkeypatch):
    monkeypatch.setattr(m, "KEEP", 2)
    view = View("v", ("k",), ("n",), lambda df: df.select("k", F.lit(1).cast("long").alias("n"), "t"), "t")
    rng, counts, now = random.Random(6), Maintained(spark, view), {}
    frame = lambda rows: spark.createDataFrame(list(rows), "k string, t long")
    for batch in range(5):
        change = {i: (rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(100)])) for i in rng.sample(range(40), 15)}
        gone = [i for i in rng.sample(range(40), 3) if i not in change]
        before = [now[i] for i in [*change, *gone] if i in now]
        counts.apply(batch, frame(before), frame(change.values()))
        counts.apply(batch, frame(before), frame(change.values()))  # a repeated batch counts once
        now = {i: r for i, r in (now | change).items() if i not in gone}
        want = {k: sum(1 for r in now.values() if r[0] == k) for k in {r[0] for r in now.values()}}
        assert dict(map(tuple, counts.sums().collect())) == want
        if batch == 2:
            counts.fold(2)
            best = {}
            for k, t in now.values():
                if t is not None:
                    best[k] = max(t, best.get(k, t))
            assert dict(map(tuple, counts.largest().collect())) == best
    every = Maintained(spark, View("w", (), ("n",), lambda df: df.select(F.lit(1).cast("long").alias("n"), "t"), "t"))
    assert every.sums().count() == 0
    every.apply(0, after=frame([("a", t) for t in (1, 2, 3, 4)]))
    every.fold(0)
    assert every.largest().collect()[0][0] == 4
    every.apply(1, before=frame([("a", 4)]))
    assert every.largest().collect()[0][0] == 3
    every.apply(2, before=frame([("a", 3)]))
    with pytest.raises(RecountNeeded):
        every.largest()
    every.apply(3, before=frame([("a", 1), ("a", 2)]))
    assert every.largest().count() == 0 and every.sums().count() == 0


def test_followed_counts_take_a_batch_once_and_ignore_old_changes(spark):
    view = View("v", ("actor_id",), ("n",), lambda df: df.select("actor_id", F.lit(1).cast("long").alias("n")))
    rows = lambda *r: spark.createDataFrame(list(r), feed.SCHEMA)
    counts = FollowedView(spark, view)
    counts.take(rows((1, "a", 1, "upsert", 1, "x"), (2, "b", 2, "upsert", 1, "x"), (3, "b", 1, "upsert", 2, "y")), 0)
    counts.take(rows((9, "z", 9, "upsert", 1, "x")), 0)  # done already
    assert dict(map(tuple, counts.sums().collect())) == {"b": 2}
    counts = FollowedView(spark, view, counts.path)
    counts.take(rows((4, "c", 2, "delete", 2, None), (5, "old", 1, "upsert", 1, "x")), 1)
    assert dict(map(tuple, counts.sums().collect())) == {"b": 1}
    assert counts.table.count() == 2  # the deleted one stays as a tombstone
