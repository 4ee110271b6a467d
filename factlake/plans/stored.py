"""Queries of tables and counts that batches change in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import views as v
from factlake.operators import ranking as r
from factlake.operators import reconcile as rec
from factlake.operators.maintained import Maintained, View, lengths_view, stats_view, terms_view
from factlake.operators.stored import FactStore
from factlake.plans.registry import query
from factlake.plans.replication import LATEST, _versions
from factlake.sources import feed, registry, snapshots
from factlake.staging import new_dir
from factlake.streaming.maintained import FollowedView
from factlake.views import sql

FACT = "id long, content string, source_id string, fact_type string, entity_ids array<string>, created_at long"


def _inserted(spark: SparkSession, d: str) -> tuple[FactStore, DataFrame]:
    """A store that got views first, then clicks and all else; with the receipts."""
    rows = v.facts(spark, d).select("id", "content", "source_id", "fact_type", F.array("entity").alias("entity_ids"), "created_at")
    store, receipts = FactStore(spark, FACT), None
    for part in ("fact_type = 'view'", "fact_type = 'click'", "fact_type NOT IN ('view', 'click')"):
        got = store.insert(rows.where(part))
        receipts = got if receipts is None else receipts.unionByName(got)
    return store, receipts


KEYED_TURN = "turn AS (SELECT *, CASE fact_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS turn FROM facts)"


@query("l1_keyed_inserts", sql("SELECT arg_min(id, turn * 1000000000000 + id) AS id, content, source_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM turn GROUP BY content, source_id", KEYED_TURN))
def l1k(spark: SparkSession, d: str) -> DataFrame:
    """Three batches into a keyed store; of equal contents the first of the first batch stays."""
    store, _ = _inserted(spark, d)
    return store.rows().select("id", "content", "source_id", F.array_join("entity_ids", ",").alias("entities"))


@query("l1_keyed_receipts", sql("SELECT id, first_value(id) OVER w AS stored_id, id <> first_value(id) OVER w AS merged FROM turn WINDOW w AS (PARTITION BY content, source_id ORDER BY turn, id)", KEYED_TURN))
def l1kr(spark: SparkSession, d: str) -> DataFrame:
    return _inserted(spark, d)[1]


@query("s24_keyed_merge", sql("""SELECT id, CASE WHEN fact_type IN ('purchase', 'signup') THEN content || '!' ELSE content END AS content,
CASE WHEN fact_type IN ('purchase', 'signup') THEN created_at + 1 ELSE created_at END AS updated_at FROM facts"""))
def s24k(spark: SparkSession, d: str) -> DataFrame:
    """Two replicas merged into a keyed store, the second over the first."""
    store = FactStore(spark, "id long, content string, source_id string, updated_at long")
    for rows in _versions(spark, d):
        store.merge(rows)
    return store.rows().select("id", "content", "updated_at")


@query("a4_maintained_stats", sql("""SELECT fact_type, count(*) AS n, count(*) FILTER (superseded_at IS NULL) AS n_current,
count(*) FILTER (pinned AND fact_type <> 'click') AS n_pinned, max(created_at) AS last_ingest FROM facts WHERE NOT (fact_type = 'error' AND created_at >= 1706000000000) GROUP BY 1"""))
def a4m(spark: SparkSession, d: str) -> DataFrame:
    """Facts come in two batches, clicks are unpinned, the latest errors are deleted, and views are superseded and restored."""
    facts = v.facts(spark, d)
    clicks, views, errors = (facts.where(c) for c in ("fact_type = 'click'", "fact_type = 'view'", "fact_type = 'error' AND created_at >= 1706000000000"))
    ended = views.withColumn("superseded_at", F.lit(1))
    counts = Maintained(spark, stats_view())
    counts.apply(0, after=facts.where("fact_type <> 'signup'"))
    counts.apply(1, after=facts.where("fact_type = 'signup'"))
    counts.apply(2, before=clicks, after=clicks.withColumn("pinned", F.lit(False)))
    counts.apply(3, before=views, after=ended)
    counts.fold(3)
    counts.apply(4, before=ended.unionByName(errors), after=views)
    left = facts.where(~F.coalesce((F.col("fact_type") == "error") & (F.col("created_at") >= 1_706_000_000_000), F.lit(False)))
    now = left.withColumn("pinned", F.col("pinned") & (F.col("fact_type") != "click"))
    keys = "fact_type"
    return counts.sums().join(counts.largest(table=now), keys, "left")


@query("a25_maintained_terms", sql("SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM tokens WHERE source_id IS DISTINCT FROM 'es' GROUP BY 1"))
def a25m(spark: SparkSession, d: str) -> DataFrame:
    """All texts are added, then those of one language are taken back."""
    texts = v.texts(spark, d)
    counts = Maintained(spark, terms_view(r.tokens))
    counts.apply(0, after=texts)
    counts.apply(1, before=texts.where("source_id = 'es'"))
    return counts.sums()


@query("a25_maintained_lengths", sql("SELECT (SELECT count(*) FROM texts WHERE source_id IS DISTINCT FROM 'es') AS documents, (SELECT count(*) FROM tokens WHERE source_id IS DISTINCT FROM 'es') AS terms"))
def a25l(spark: SparkSession, d: str) -> DataFrame:
    texts = v.texts(spark, d)
    counts = Maintained(spark, lengths_view(r.tokens))
    counts.apply(0, after=texts)
    counts.apply(1, before=texts.where("source_id = 'es'"))
    return counts.sums()


def _by_actor(rows: DataFrame) -> DataFrame:
    return rows.select("actor_id", F.lit(1).cast("long").alias("n"), F.length("body").cast("long").alias("chars"))


@query("z2_followed_counts", sql("SELECT actor_id, count(*) AS n, sum(length(body))::BIGINT AS chars FROM latest WHERE operation <> 'delete' GROUP BY 1", LATEST))
def z2f(spark: SparkSession, d: str) -> DataFrame:
    """Live resources by actor, kept by a stream of the change feed that stops and goes on."""
    spark.dataSource.register(feed.ChangeFeed)
    log, checkpoint = new_dir(spark, "feed"), new_dir(spark, "feed-checkpoint")
    counts = FollowedView(spark, View("actors", ("actor_id",), ("n", "chars"), _by_actor))
    for part in ("seq <= 500", "seq > 500 AND seq <= 5000", "seq > 5000"):
        feed.append_log(v.changes(spark, d).where(part), log, 1)
        counts = FollowedView(spark, counts.view.view, counts.path)  # a new process finds what is stored
        counts.follow(spark.readStream.format("changefeed").option("path", log).load(), checkpoint).awaitTermination()
    return counts.sums()


def _replicas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas of facts: this one lacks purchases of one day and has old signups of another; that one lacks errors of a third."""
    rows = v.facts(spark, d).select("id", "content", "fact_type", F.col("created_at").alias("updated_at"))
    day = lambda n: F.floor(F.col("updated_at") / 86_400_000) == 19_723 + n
    edited = day(7) & (F.col("fact_type") == "signup")
    there = rows.where(~(day(9) & (F.col("fact_type") == "error")))
    there = there.withColumn("content", F.when(edited, F.concat("content", F.lit("+"))).otherwise(F.col("content"))).withColumn("updated_at", F.when(edited, F.col("updated_at") + 1).otherwise(F.col("updated_at")))
    return rows.where(~(day(5) & (F.col("fact_type") == "purchase"))), there


DAYS = "days AS (SELECT *, created_at // 86400000 - 19723 AS day FROM facts)"


@query("s15_reconciled_ranges", sql("""SELECT id, CASE WHEN day = 7 AND fact_type = 'signup' THEN content || '+' ELSE content END AS content,
CASE WHEN day = 7 AND fact_type = 'signup' THEN created_at + 1 ELSE created_at END AS updated_at FROM days""", DAYS))
def s15r(spark: SparkSession, d: str) -> DataFrame:
    """This replica after it got what the other has and it has not."""
    here, there = _replicas(spark, d)
    come, _ = rec.reconcile(here, there, ["id"], "updated_at", rec.depth_for(here.count()))
    return here.join(come.select("id"), "id", "left_anti").unionByName(come).select("id", "content", "updated_at")


@query("s15_ranges_sent", sql("""SELECT id, CASE WHEN fact_type = 'error' THEN 'there' ELSE 'here' END AS goes FROM days
WHERE (day = 5 AND fact_type = 'purchase') OR (day = 7 AND fact_type = 'signup') OR (day = 9 AND fact_type = 'error')""", DAYS))
def s15s(spark: SparkSession, d: str) -> DataFrame:
    """The rows that pass, and to which side."""
    here, there = _replicas(spark, d)
    come, go = rec.reconcile(here, there, ["id"], "updated_at", rec.depth_for(here.count()))
    return come.select("id", F.lit("here").alias("goes")).unionByName(go.select("id", F.lit("there").alias("goes")))


def _parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"facts": v.facts(spark, d).select("id", "content", "fact_type"), "entities": v.entities(spark, d), "relations": v.relations(spark, d)}


@query("s20_verified_snapshot", sql("SELECT 'facts' AS name, count(*) AS n FROM facts UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations"))
def s20v(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of three tables, checked file by file before it takes the place of the one before."""
    target = snapshots.Snapshots(spark)
    target.put({name: df.limit(0) for name, df in _parts(spark, d).items()})
    target.put(_parts(spark, d))
    tables = target.tables()
    counts = [tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in sorted(tables)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("s29_store_registry", sql("""SELECT 'events' AS project, CASE WHEN fact_type = 'view' THEN 'cold' ELSE 'hot' END AS tier, id, content FROM facts WHERE source_id IS DISTINCT FROM 'ns1'
UNION ALL SELECT 'documents', 'hot', id, content FROM texts WHERE source_id IS DISTINCT FROM 'ns1'"""))
def s29r(spark: SparkSession, d: str) -> DataFrame:
    """Two projects, one of them in two tiers, and a third whose files cannot be read: it costs its own rows only."""
    stores = registry.Stores(spark)
    facts = v.facts(spark, d).select("id", "content", "source_id", "fact_type")
    stores.put("events", "hot", facts.where("fact_type <> 'view'").drop("fact_type"))
    stores.put("events", "cold", facts.where("fact_type = 'view'").drop("fact_type"))
    stores.put("documents", "hot", v.texts(spark, d).select("id", "content", "source_id"))
    stores.register("lost", "hot", new_dir(spark, "no-store"))
    return stores.scan(F.col("source_id").isNull() | (F.col("source_id") != "ns1")).select("project", "tier", "id", "content")


@query("s29_store_report", sql("SELECT 'events' AS project, 'hot' AS tier, true AS readable UNION ALL SELECT 'lost', 'hot', false"))
def s29s(spark: SparkSession, d: str) -> DataFrame:
    """Which stores can be read."""
    stores = registry.Stores(spark)
    stores.put("events", "hot", v.facts(spark, d).select("id", "content", "source_id"))
    stores.register("lost", "hot", new_dir(spark, "no-store"))
    return stores.report().select("project", "tier", F.col("error").isNull().alias("readable"))
