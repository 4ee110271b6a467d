"""Replicas made equal by ranges, checked snapshots, and many stores as one table."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import reconcile as rec
from factlake.sources import snapshots as sn
from factlake.sources.registry import Stores
from factlake.staging import new_dir

ROW = "id long, kind string, content string, updated_at long"


def frame(spark, rows):
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], ROW)


def read(df):
    return {(r["id"], r["kind"]): (r["content"], r["updated_at"]) for r in df.collect()}


def test_replicas_become_equal(spark, monkeypatch):
    monkeypatch.setattr(rec, "LEAF", 4)
    rng, keys = random.Random(2), ["id", "kind"]
    same = {(i, rng.choice(["a", None])): (rng.choice([None, "", f"t{i}"]), rng.choice([None, i % 5])) for i in range(2000)}
    mine, theirs = dict(same), dict(same)
    for k in rng.sample(sorted(same, key=str), 12):
        rng.choice([mine, theirs])[k] = ("edited", rng.choice([None, 9]))
    for k in rng.sample(sorted(same, key=str), 4):
        mine.pop(k)
    theirs[(99_999, None)] = (None, None)
    a, b = frame(spark, mine).cache(), frame(spark, theirs).cache()
    come, go = (x.cache() for x in rec.reconcile(a, b, keys, "updated_at", rec.depth_for(2000)))
    left, right = mine | read(come), theirs | read(go)
    assert left == right and come.columns == a.columns
    for k in {*mine, *theirs}:  # an edit without a time loses to any with one
        got, best = left[k], [r[k] for r in (mine, theirs) if k in r]
        assert got in best and (got[1] is not None or all(x[1] is None for x in best))
    found = rec.difference(a, b, keys, rec.depth_for(2000))
    assert found.rows.count() < 17 * 2 * 4 * 4 and found.nodes < 17 * 16 * found.rounds
    assert come.count() + go.count() <= 17


def test_equal_and_empty_replicas(spark):
    a = frame(spark, {(i, "a"): ("x", 1) for i in range(50)})
    found = rec.difference(a, a, ["id", "kind"], 8)
    assert (found.rows.count(), found.nodes, found.rounds) == (0, 1, 1)
    none = a.limit(0)
    assert [x.count() for x in rec.reconcile(a, none, ["id", "kind"], "updated_at", 8)] == [0, 50]
    assert [x.count() for x in rec.reconcile(none, none, ["id", "kind"], "updated_at", 0)] == [0, 0]


def flip(file, seen_by_file_system=False):
    if not seen_by_file_system:
        os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with open(file, "r+b") as f:
        f.seek(os.path.getsize(file) // 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 1]))


def test_a_flipped_byte_is_found_and_nothing_is_replaced(spark):
    shots = sn.Snapshots(spark, rows_a_file=300)
    assert shots.tables() == {}
    first = shots.put({"numbers": spark.range(1000), "none": spark.range(0)})
    for damage, fault in ((flip, "changed"), (lambda f: flip(f, True), "missing"), (os.remove, "missing"), (lambda f: os.link(f, f.replace("part-", "part-x")), "added")):
        name = shots.write({"numbers": spark.range(2000)})
        file = sorted(glob.glob(f"{shots.path}/data/{name}/numbers/part-*.parquet"))[1]
        damage(file)
        with pytest.raises(sn.DamagedSnapshot, match=fault):
            shots.adopt(name, ["numbers"])
        assert [r["fault"] for r in shots.check(name).collect()] == [fault]
        assert shots.current() == (first, ["none", "numbers"]) and shots.tables()["numbers"].count() == 1000
    shots.put({"numbers": spark.range(7)})
    assert {k: df.count() for k, df in shots.tables().items()} == {"numbers": 7}


def test_a_broken_store_costs_its_rows_only(spark):
    stores = Stores(spark)
    assert stores.scan().count() == 0 and stores.report().count() == 0
    rows = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("content"), F.lit("ns").alias("source_id"))
    stores.put("a", "hot", rows.repartition(4))
    stores.put("a", "cold", rows.withColumn("content", F.lit("old")).unionByName(rows.withColumn("id", F.col("id") + 1000)))
    stores.put("b", "hot", rows.drop("source_id").withColumn("project", F.lit("clashing")))
    stores.register("c", "hot", new_dir(spark, "none"))
    broken = new_dir(spark, "broken")
    os.makedirs(broken)
    with open(f"{broken}/part-0.parquet", "w") as f:
        f.write("no Parquet")
    stores.register("d", "hot", broken)
    with pytest.raises(ValueError, match="tier"):
        stores.register("a", "warm", broken)
    assert {(r["project"], r["tier"]) for r in stores.report().where("error IS NOT NULL").collect()} == {("c", "hot"), ("d", "hot")}
    assert dict(stores.scan().groupBy("project").count().collect()) == {"a": 300, "b": 100}
    assert stores.scan(F.col("project") == "b").where("source_id IS NULL").count() == 100
    first = stores.first_tier(F.col("project") == "a")
    assert first.count() == 200 and first.where("content = 'old'").count() == 0


def test_a_filter_leaves_stores_out_and_reaches_files(spark):
    stores = Stores(spark)
    for project in ("a", "b", "c"):
        stores.put(project, "hot", spark.range(10).selectExpr("id", f"'{project}' AS content", "'ns' AS source_id"))
    plan = stores.scan(F.col("project") == "b").where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThan(id,5)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_damaged_files_are_named(spark):
    stores = Stores(spark)
    stores.put("a", "hot", spark.range(100).selectExpr("id", "'x' AS content", "'ns' AS source_id").repartition(4))
    place = stores.entries()[0][2]
    file = sorted(glob.glob(f"{place}/part-*.parquet"))[2]
    os.remove(f"{place}/.{os.path.basename(file)}.crc")
    with open(file, "w") as f:
        f.write("damaged")
    with pytest.raises(Exception, match="."):
        stores.scan().collect()
    assert stores.scan(skip_damaged=True).count() == 75
    assert [r["file"] for r in stores.unread_files().collect()] == [os.path.basename(file)]
