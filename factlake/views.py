"""The driver's tables as facts, entities, relations, texts and vectors.

Each view has a twin in SQL (``PRELUDE``), so that every query can be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a time without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as time-versioned facts: the next of the same kind supersedes one."""
    e = table(spark, sf_dir, "events")
    then = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    entity = F.concat(F.lit("customer:"), "user_id")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("props").alias("content"),
        F.col("event_type").alias("fact_type"),
        entity.alias("entity"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("ns"), F.col("user_id") % 5)).alias("source_id"),
        F.concat_ws("#", F.concat(F.lit("feed/"), "event_type"), "user_id").alias("source"),
        (F.col("value") / (F.col("value") + 10)).alias("source_confidence"),
        millis("ts").alias("created_at"),
        F.when(F.col("event_type") == "click", millis("ts") - 3_600_000).alias("observed_at"),
        F.lead(millis("ts")).over(then).alias("superseded_at"),
        F.lead("event_id").over(then).alias("superseded_by"),
        (F.col("value") > 40).alias("pinned"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text facts in the namespace of their language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", F.col("lang").alias("source_id"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    tag = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    row = lambda kind, key, name, *tags: [
        F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"),
        F.array(*tags).alias("tags"), F.col(key).cast("long").alias("updated_at"),
    ]
    parts = [
        t("region").select(*row("region", "r_regionkey", "r_name", F.lit("place"))),
        t("nation").select(*row("nation", "n_nationkey", "n_name", F.lit("place"), tag("region", "n_regionkey"))),
        t("customer").select(*row("customer", "c_custkey", "c_name", F.col("c_mktsegment"), tag("nation", "c_nationkey"))),
        t("supplier").select(*row("supplier", "s_suppkey", "s_name", F.lit("seller"), tag("nation", "s_nationkey"))),
        t("part").select(*row("part", "p_partkey", "p_name", F.col("p_brand"), F.col("p_type"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge: events to customers, and orders to the parts and suppliers in them."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("fact_id"), F.concat(F.lit("customer:"), "user_id").alias("entity_id")
    )
    items = table(spark, sf_dir, "lineitem")
    fact = F.concat(F.lit("o"), "l_orderkey", F.lit("."), "l_linenumber").alias("fact_id")
    p = items.select(fact, F.concat(F.lit("part:"), "l_partkey").alias("entity_id"))
    s = items.select(fact, F.concat(F.lit("supplier:"), "l_suppkey").alias("entity_id"))
    return e.unionByName(p).unionByName(s).distinct()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, relation_type, target_id, scope, weight): places, supply and trade."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, kind, b, weight=None: df.select(
        a.alias("source_id"), F.lit(kind).alias("relation_type"), b.alias("target_id"),
        F.lit(None).cast("string").alias("scope"), (F.lit(1.0) if weight is None else weight).alias("weight"),
    )
    k = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    supply = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("w"))
    flow = (
        t("lineitem").select("l_orderkey", "l_suppkey")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "c_nationkey").agg(F.count("*").cast("double").alias("w"))
    )
    best = Window.partitionBy("s_nationkey").orderBy(F.desc("w"), "c_nationkey")
    flow = flow.where("s_nationkey <> c_nationkey").withColumn("n", F.row_number().over(best)).where("n = 1")
    return (
        edge(t("nation"), k("nation:", "n_nationkey"), "part_of", k("region:", "n_regionkey"))
        .unionByName(edge(t("customer"), k("customer:", "c_custkey"), "located_in", k("nation:", "c_nationkey")))
        .unionByName(edge(t("supplier"), k("supplier:", "s_suppkey"), "located_in", k("nation:", "s_nationkey")))
        .unionByName(edge(supply, k("part:", "l_partkey"), "supplied_by", k("supplier:", "l_suppkey"), F.col("w")))
        .unionByName(edge(flow, k("nation:", "s_nationkey"), "sells_to", k("nation:", "c_nationkey"), F.col("w")))
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: a user is a resource, an ``error`` deletes it."""
    e = table(spark, sf_dir, "events")
    of = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("actor_id"),
        F.col("user_id").alias("id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"),
        F.row_number().over(of).cast("long").alias("revision"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("body"),
    )


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


PRELUDE = """
facts AS (SELECT event_id AS id, props AS content, event_type AS fact_type, 'customer:' || user_id AS entity,
    CASE WHEN event_type <> 'view' THEN 'ns' || (user_id % 5) END AS source_id,
    'feed/' || event_type || '#' || user_id AS source, value / (value + 10) AS source_confidence,
    epoch_us(ts) // 1000 AS created_at, CASE WHEN event_type = 'click' THEN epoch_us(ts) // 1000 - 3600000 END AS observed_at,
    lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_at,
    lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by,
    value > 40 AS pinned FROM events),
texts AS (SELECT doc_id AS id, text AS content, source, lang AS source_id FROM documents),
entities AS (
    SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS entity_type, ['place'] AS tags, r_regionkey::BIGINT AS updated_at FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', ['place', 'region' || n_regionkey], n_nationkey::BIGINT FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', [c_mktsegment, 'nation' || c_nationkey], c_custkey FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', ['seller', 'nation' || s_nationkey], s_suppkey FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', [p_brand, p_type], p_partkey FROM part),
fact_entities AS (
    SELECT 'e' || event_id AS fact_id, 'customer:' || user_id AS entity_id FROM events
    UNION SELECT 'o' || l_orderkey || '.' || l_linenumber, 'part:' || l_partkey FROM lineitem
    UNION SELECT 'o' || l_orderkey || '.' || l_linenumber, 'supplier:' || l_suppkey FROM lineitem),
flow AS (SELECT s_nationkey, c_nationkey, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
relations AS (
    SELECT 'nation:' || n_nationkey AS source_id, 'part_of' AS relation_type, 'region:' || n_regionkey AS target_id,
        NULL::VARCHAR AS scope, 1.0::DOUBLE AS weight FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, NULL, 1.0 FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, NULL, 1.0 FROM supplier
    UNION ALL SELECT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, NULL, count(*)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey
    UNION ALL SELECT 'nation:' || s_nationkey, 'sells_to', 'nation:' || c_nationkey, NULL, w FROM
        (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY w DESC, c_nationkey) AS n FROM flow) WHERE n = 1),
changes AS (SELECT event_id AS seq, event_type AS actor_id, user_id AS id,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision,
    CASE WHEN event_type <> 'error' THEN props END AS body FROM events),
tokens AS (SELECT id, source_id, unnest(list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM texts)"""


def sql(select: str, *ctes: str) -> str:
    """A query over the views, with further common tables before it."""
    return "WITH RECURSIVE " + ",\n".join([PRELUDE, *ctes]) + "\n" + select
