"""Queries of exchange formats, change logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import views as v
from factlake.operators import changes as c
from factlake.operators import lifecycle as life
from factlake.plans.registry import query
from factlake.sources import feed
from factlake.sources import interchange as x
from factlake.staging import new_dir
from factlake.streaming import changes as s
from factlake.views import sql


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("s13_jsonl_export", sql("""SELECT '{"schema_version":2,"exported_by":"factlake"}' AS line UNION ALL SELECT '{"type":"entity","data":{"id":' || n_nationkey || ',"name":"' || n_name || '"}}' FROM nation"""))
def s13(spark: SparkSession, d: str) -> DataFrame:
    return x.export_lines({"entity": _nations(spark, d)})


@query("s14_jsonl_import", sql("SELECT n_nationkey AS id, n_name AS name FROM nation"))
def s14(spark: SparkSession, d: str) -> DataFrame:
    """Export, write, read and parse again."""
    path = new_dir(spark, "export")
    x.write_lines(x.export_lines({"entity": _nations(spark, d)}), path)
    return x.parse_lines(x.read_lines(spark, path), {"entity": "id:int,name:string"})[0]["entity"]


@query("s15_delta_export", sql("SELECT id, created_at AS updated_at FROM facts WHERE created_at > 1705000000000 OR (created_at = 1705000000000 AND id > 0)"))
def s15(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).select("id", F.col("created_at").alias("updated_at"))
    return x.delta({"fact": rows}, {"fact": x.updated_after(1_705_000_000_000, 0)})["fact"]


@query("s17_envelope_preflight", sql("SELECT (SELECT count(*) FROM nation) AS entity_count, (SELECT max(n_nationkey) FROM nation) AS entity_last, count(*) AS fact_count, max(id) AS fact_last FROM facts"))
def s17(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d).select("id", "content")
    cursor = x.preflight(x.envelope({"entity": _nations(spark, d), "fact": facts}, 0))
    names = ["entity_count", "entity_last", "fact_count", "fact_last"]
    return spark.createDataFrame([tuple(cursor[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("s19_backup_restore", sql("SELECT n_nationkey AS id, n_name AS name FROM nation"))
def s19(spark: SparkSession, d: str) -> DataFrame:
    path = new_dir(spark, "backup")
    x.backup({"entities": _nations(spark, d)}, path)
    return x.restore(spark, path)["entities"]


@query("s23_wal_compaction", sql("SELECT doc_id AS fact_id, quality = 1 AS helpful FROM labels"))
def s23(spark: SparkSession, d: str) -> DataFrame:
    path = new_dir(spark, "wal")
    votes = v.table(spark, d, "labels").select(F.col("doc_id").alias("fact_id"), (F.col("quality") == 1).alias("helpful"))
    x.append_segment(votes.where("helpful"), path)
    x.append_segment(votes.where("NOT helpful"), path)
    return x.compact(spark, path, "fact_id long, helpful boolean", path + "-merged")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas of facts: one of all types but purchases, one with newer signups and all purchases."""
    rows = v.facts(spark, d).select("id", "content", F.concat("entity", F.lit("/"), "fact_type", F.lit("/"), "id").alias("source_id"), F.col("created_at").alias("updated_at"), "fact_type")
    local = rows.where("fact_type <> 'purchase'").drop("fact_type")
    new = rows.where("fact_type IN ('purchase', 'signup', 'view')")
    shift = F.when(F.col("fact_type") == "view", -1).otherwise(1)
    return local, new.withColumn("updated_at", F.col("updated_at") + shift).withColumn("content", F.concat("content", F.lit("!"))).drop("fact_type")


@query("s24_lww_merge", sql("""SELECT id, CASE WHEN fact_type IN ('purchase', 'signup') THEN content || '!' ELSE content END AS content,
CASE WHEN fact_type IN ('purchase', 'signup') THEN created_at + 1 ELSE created_at END AS updated_at FROM facts"""))
def s24(spark: SparkSession, d: str) -> DataFrame:
    return life.lww_merge(*_versions(spark, d)).select("id", "content", "updated_at")


@query("s25_lww_entities", sql("SELECT id, name, CASE WHEN entity_type = 'nation' THEN updated_at + 5 ELSE updated_at END AS updated_at FROM entities WHERE entity_type IN ('nation', 'region')"))
def s25(spark: SparkSession, d: str) -> DataFrame:
    """Newer nations win; a stranger with a known name is dropped."""
    e = v.entities(spark, d).where("entity_type IN ('nation', 'region')").select("id", "name", "entity_type", "updated_at")
    newer = e.where("entity_type = 'nation'").withColumn("updated_at", F.col("updated_at") + 5)
    stranger = e.where("entity_type = 'region'").withColumn("id", F.concat(F.lit("other:"), "id"))
    return life.lww_entities(e, newer.unionByName(stranger)).select("id", "name", "updated_at")


@query("s26_edge_upsert_diff", sql("SELECT source_id, target_id FROM relations WHERE relation_type = 'sells_to' AND weight > 5"))
def s26(spark: SparkSession, d: str) -> DataFrame:
    """Only edges that differ from what is stored are written."""
    from factlake.operators.aggregates import record_diff

    r = v.relations(spark, d).where("relation_type = 'sells_to'")
    key = F.concat_ws("|", "source_id", "target_id").alias("k")
    new = r.select(key, F.least("weight", F.lit(5.0)).alias("weight"))
    changed = record_diff(r.select(key, "weight"), new, "k")
    parts = F.split("k", r"\|")
    return changed.select(parts[0].alias("source_id"), parts[1].alias("target_id"))


@query("s29_multi_store", sql("SELECT 'events' AS project, id FROM facts WHERE pinned UNION ALL SELECT 'documents', id FROM texts WHERE source_id = 'es'"))
def s29(spark: SparkSession, d: str) -> DataFrame:
    a = v.facts(spark, d).where("pinned").select(F.lit("events").alias("project"), "id")
    return a.unionByName(v.texts(spark, d).where("source_id = 'es'").select(F.lit("documents").alias("project"), "id"))


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM changes) WHERE n = 1)"


@query("s30_resource_snapshot", sql("SELECT id, seq, operation, revision, body FROM latest", LATEST))
def s30(spark: SparkSession, d: str) -> DataFrame:
    return c.snapshot(v.changes(spark, d)).select("id", "seq", "operation", "revision", "body")


@query("s31_resource_get", sql("SELECT id, seq, body FROM latest WHERE id = 42", LATEST))
def s31(spark: SparkSession, d: str) -> DataFrame:
    return c.snapshot(v.changes(spark, d).where("id = 42")).select("id", "seq", "body")


@query("z1_change_feed", sql("SELECT seq, id, operation, body FROM changes WHERE seq > 500 ORDER BY seq LIMIT 101"))
def z1(spark: SparkSession, d: str) -> DataFrame:
    return c.feed(v.changes(spark, d), 500, 100).select("seq", "id", "operation", "body")


@query("z4_projected_cursor", sql("SELECT count(*) FILTER (actor_id <> 'purchase') AS visible, max(seq) AS cursor FROM (SELECT * FROM changes WHERE seq > 500 ORDER BY seq LIMIT 101)"))
def z4(spark: SparkSession, d: str) -> DataFrame:
    batch = c.feed(v.changes(spark, d), 500, 100)
    c.check_batch(batch, 500)
    seen, cursor = c.projected(batch, F.col("actor_id") != "purchase")
    return seen.agg(F.count("*").alias("visible")).withColumn("cursor", F.lit(cursor))


@query("z5_replica", sql("SELECT id, seq, operation, revision FROM latest", LATEST))
def z5(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the log, applied in turn; tombstones stay."""
    log = v.changes(spark, d)
    first = c.apply_batch(log.limit(0), log.where("seq <= 5000"))
    return c.apply_batch(first, log.where("seq > 5000")).select("id", "seq", "operation", "revision")


@query("z6_pull_stream", sql("SELECT count(*) FILTER (operation <> 'delete') AS live, count(*) FILTER (operation = 'delete') AS tombstones, max(seq) AS cursor FROM latest", LATEST))
def z6(spark: SparkSession, d: str) -> DataFrame:
    """A replica follows the log as a stream until it has caught up."""
    path, log = new_dir(spark, "log"), v.changes(spark, d)
    log.write.parquet(path)
    schema = log.schema
    replica = s.Replica(spark, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    s.follow(spark.readStream.schema(schema).parquet(path), replica, new_dir(spark, "follow")).awaitTermination()
    return c.status(replica.table())


@query("z6_feed_source", sql("SELECT count(*) AS n, count(DISTINCT seq) AS seqs, sum(seq)::BIGINT AS total, count(body) AS bodies FROM changes"))
def z6f(spark: SparkSession, d: str) -> DataFrame:
    """The log as a data source: a stream takes the first changes, stops, and goes on from its checkpoint when the rest has come; no change is lost or comes twice."""
    spark.dataSource.register(feed.ChangeFeed)
    log, done, out = new_dir(spark, "feed"), new_dir(spark, "feed-checkpoint"), new_dir(spark, "feed-taken")
    changes = v.changes(spark, d)
    take = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    for part in ("seq <= 500", None, "seq > 500"):  # the second start finds nothing new
        if part:
            feed.append_log(changes.where(part), log, 1)
        stream = spark.readStream.format("changefeed").option("path", log).option("chunk", 1500).load()
        stream.writeStream.foreachBatch(take).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
    taken = spark.read.schema(feed.SCHEMA).parquet(out)
    return taken.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("seqs"), F.sum("seq").alias("total"), F.count("body").alias("bodies"))


@query("z1_feed_after", sql("SELECT seq, id, operation, body FROM changes WHERE seq > 500"))
def z1f(spark: SparkSession, d: str) -> DataFrame:
    """All changes after a cursor, from the source."""
    spark.dataSource.register(feed.ChangeFeed)
    log = new_dir(spark, "feed")
    feed.append_log(v.changes(spark, d), log, 1)
    return spark.read.format("changefeed").option("path", log).option("after", 500).load().select("seq", "id", "operation", "body")


@query("z7_commands", sql("SELECT cast(user_id AS VARCHAR) || '/' || event_type AS command_id, count(*) FILTER (props = first) AS replays, count(*) FILTER (props <> first) AS conflicts FROM (SELECT *, first_value(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS first FROM events) GROUP BY 1"))
def z7(spark: SparkSession, d: str) -> DataFrame:
    log = v.table(spark, d, "events").select(F.concat_ws("/", "user_id", "event_type").alias("command_id"), F.col("event_id").alias("at"), F.col("event_type").alias("actor"), F.col("props").alias("payload"))
    receipts, conflicts = c.commands(log)
    lost = conflicts.groupBy("command_id").agg(F.count("*").alias("conflicts"))
    return receipts.select("command_id", "replays").join(lost, "command_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


@query("z9_update_cursor", sql("SELECT max(created_at) AS updated_at, arg_max(id, struct_pack(t := created_at, i := id)) AS id FROM facts"))
def z9(spark: SparkSession, d: str) -> DataFrame:
    return x.next_cursor(v.facts(spark, d).select("id", F.col("created_at").alias("updated_at")))


@query("z12_branch_merge", sql("SELECT id, content || '*' AS content, greatest(created_at, 1709500000000) AS updated_at FROM facts WHERE fact_type = 'error'"))
def z12(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).select("id", "content", "fact_type", F.col("created_at").alias("updated_at"))
    edit = F.when(F.col("fact_type") == "error", F.concat("content", F.lit("*"))).otherwise(F.col("content"))
    return c.branch_changes(rows, rows.withColumn("content", edit), 1_709_500_000_000).select("id", "content", "updated_at")


@query("z13_stale_leases", sql("SELECT id FROM facts WHERE fact_type = 'click' AND superseded_at IS NULL AND created_at + 86400000 <= 1710000000000"))
def z13(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).where("fact_type = 'click' AND superseded_at IS NULL AND created_at + 86400000 <= 1710000000000").select("id")


@query("v13_replica_status", sql("SELECT count(*) FILTER (operation <> 'delete') AS live, count(*) FILTER (operation = 'delete') AS tombstones, max(seq) AS cursor FROM latest", LATEST))
def v13(spark: SparkSession, d: str) -> DataFrame:
    return c.status(c.snapshot(v.changes(spark, d)))


@query("v10_audit_count", sql("SELECT actor_id, count(*) AS n FROM changes GROUP BY 1"))
def v10(spark: SparkSession, d: str) -> DataFrame:
    return v.changes(spark, d).groupBy("actor_id").agg(F.count("*").alias("n"))


@query("v30_tag_index", sql("SELECT id, unnest(tags) AS tag FROM entities"))
def v30(spark: SparkSession, d: str) -> DataFrame:
    return v.entities(spark, d).select("id", F.explode("tags").alias("tag"))


@query("ext_event_windows", sql("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"))
def ext_windows(spark: SparkSession, d: str) -> DataFrame:
    events = v.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = s.event_windows(events)
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
