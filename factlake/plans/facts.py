"""Queries over facts and entities: scans, predicates, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import views as v
from factlake.operators import aggregates as a
from factlake.operators import filters as f
from factlake.plans.registry import query
from factlake.views import sql

#: A time in the middle of the events, and the end of them.
T0, NOW = 1_704_844_800_000, 1_710_000_000_000
NOW_SQL, T0_SQL = str(NOW), str(T0)
IDS = [42, 7, 999_999_999, 13, 5]


@query("s1_fact_scan", sql("SELECT id, fact_type, entity, source_id, created_at FROM facts"))
def s1(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).select("id", "fact_type", "entity", "source_id", "created_at")


@query("s2_multi_get", sql(f"SELECT pos, id, content FROM facts JOIN (SELECT unnest(range({len(IDS)})) AS pos, unnest({IDS}::BIGINT[]) AS id) USING (id)"))
def s2(spark: SparkSession, d: str) -> DataFrame:
    return f.multi_get(v.facts(spark, d), IDS).select("pos", "id", "content")


@query(
    "s3_fact_get_cold",
    sql("SELECT id, 'hot' AS tier FROM facts WHERE superseded_at IS NULL UNION ALL SELECT id, 'cold' FROM facts WHERE superseded_at IS NOT NULL"),
)
def s3(spark: SparkSession, d: str) -> DataFrame:
    """Hot and cold tiers overlap; a hot row hides its cold copy."""
    facts = v.facts(spark, d)
    hot = facts.where(f.current()).select("id", F.lit("hot").alias("tier"))
    return f.prefer(hot, facts.select("id", F.lit("cold").alias("tier")))


@query(
    "s4_entity_list",
    sql("""SELECT id, name, entity_type, coalesce(n, 0) AS fact_count FROM entities
LEFT JOIN (SELECT entity_id, count(*) AS n FROM fact_entities GROUP BY 1) c ON entity_id = id WHERE coalesce(n, 0) >= 3"""),
)
def s4(spark: SparkSession, d: str) -> DataFrame:
    return a.entity_counts(v.entities(spark, d), v.fact_entities(spark, d)).where("fact_count >= 3").select("id", "name", "entity_type", "fact_count")


@query("s5_entity_by_name", sql("SELECT n.r_name AS wanted, e.id, e.entity_type FROM (SELECT lower(r_name) AS r_name FROM region UNION ALL SELECT lower(n_name) FROM nation) n JOIN entities e ON lower(e.name) = n.r_name"))
def s5(spark: SparkSession, d: str) -> DataFrame:
    names = v.table(spark, d, "region").select(F.lower("r_name").alias("wanted")).union(v.table(spark, d, "nation").select(F.lower("n_name")))
    return f.entity_by_name(v.entities(spark, d), names).select("wanted", "id", "entity_type")


@query("s6_entities_all_tags", sql("SELECT id, name FROM entities WHERE list_contains(tags, 'BUILDING') AND list_contains(tags, 'nation3')"))
def s6(spark: SparkSession, d: str) -> DataFrame:
    return f.with_all_tags(v.entities(spark, d), ["BUILDING", "nation3"]).select("id", "name")


@query("s7_entities_by_type", sql("SELECT id, name, updated_at FROM entities WHERE entity_type = 'supplier' ORDER BY updated_at DESC, id DESC"))
def s7(spark: SparkSession, d: str) -> DataFrame:
    rows = v.entities(spark, d).where("entity_type = 'supplier'")
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).select("id", "name", "updated_at")


@query("s8_relation_scan", sql("SELECT source_id, relation_type, target_id, weight FROM relations"))
def s8(spark: SparkSession, d: str) -> DataFrame:
    return v.relations(spark, d).select("source_id", "relation_type", "target_id", "weight")


@query("s9_relations_by_endpoint", sql("SELECT source_id, relation_type, target_id FROM relations WHERE source_id = 'nation:3' OR target_id = 'nation:3'"))
def s9(spark: SparkSession, d: str) -> DataFrame:
    return f.edges_at(v.relations(spark, d), "nation:3").select("source_id", "relation_type", "target_id")


@query("s10_scoped_relations", sql("SELECT source_id, relation_type, target_id FROM relations WHERE scope IS NOT DISTINCT FROM NULL"))
def s10(spark: SparkSession, d: str) -> DataFrame:
    return f.scoped_edges(v.relations(spark, d), None).select("source_id", "relation_type", "target_id")


@query(
    "p1_fact_list",
    sql(f"""SELECT id, entity, source_confidence FROM facts WHERE fact_type = 'purchase' AND source_confidence >= 0.5
AND source_id = 'ns2' AND coalesce(observed_at, created_at) BETWEEN {T0} AND {NOW} AND superseded_at IS NULL"""),
)
def p1(spark: SparkSession, d: str) -> DataFrame:
    rows = f.fact_list(v.facts(spark, d), "purchase", 0.5, source_id="ns2", since=T0, until=NOW, current_only=True)
    return rows.select("id", "entity", "source_confidence")


@query("p2_time_window", sql(f"SELECT id FROM facts WHERE coalesce(observed_at, created_at) >= {T0} AND coalesce(observed_at, created_at) <= {T0 + 30 * f.DAY}"))
def p2(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).where(f.in_window(T0, T0 + 30 * f.DAY)).select("id")


@query("p3_as_of", sql(f"SELECT id, entity, fact_type FROM facts WHERE created_at <= {T0} AND (superseded_at IS NULL OR superseded_at > {T0})"))
def p3(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).where(f.as_of(T0)).select("id", "entity", "fact_type")


@query("p4_current_only", sql("SELECT id FROM facts WHERE superseded_at IS NULL"))
def p4(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).where(f.current()).select("id")


@query("p5_namespace", sql("SELECT id, source_id FROM facts WHERE source_id = 'ns1'"))
def p5(spark: SparkSession, d: str) -> DataFrame:
    return f.fact_list(v.facts(spark, d), source_id="ns1").select("id", "source_id")


@query("p6_entity_overlap", sql("SELECT DISTINCT fact_id FROM fact_entities WHERE entity_id IN ('customer:3', 'supplier:5', 'part:7')"))
def p6(spark: SparkSession, d: str) -> DataFrame:
    return a.facts_of(v.fact_entities(spark, d), ["customer:3", "supplier:5", "part:7"])


@query("p7_min_confidence", sql("SELECT id FROM facts WHERE source_confidence >= 0.8"))
def p7(spark: SparkSession, d: str) -> DataFrame:
    return f.fact_list(v.facts(spark, d), min_confidence=0.8).select("id")


@query("p8_scoped_visibility", sql("SELECT id, name FROM entities WHERE id IN (SELECT entity FROM facts WHERE source_id = 'ns3')"))
def p8(spark: SparkSession, d: str) -> DataFrame:
    return f.visible_entities(v.entities(spark, d), v.facts(spark, d), "ns3").select("id", "name")


@query("p9_redaction", sql("SELECT id, name, entity_type, '' AS tags, 0::BIGINT AS updated_at FROM entities WHERE id IN (SELECT entity FROM facts WHERE source_id = 'ns3')"))
def p9(spark: SparkSession, d: str) -> DataFrame:
    seen = f.redacted(f.visible_entities(v.entities(spark, d), v.facts(spark, d), "ns3"))
    return seen.select("id", "name", "entity_type", F.array_join("tags", ",").alias("tags"), "updated_at")


@query(
    "p10_participants",
    sql("""SELECT seq FROM changes WHERE actor_id <> 'purchase' OR (operation <> 'delete' AND
coalesce(list_contains([json_extract_string(body, '$.k')], '7'), false))"""),
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    """Purchases play the handoffs; the key in their body plays both participants."""
    body = F.when(F.col("body").isNotNull(), F.to_json(F.struct(*[F.get_json_object("body", "$.k").alias(x) for x in ("from", "to")])))
    kind = F.when(F.col("actor_id") == "purchase", "handoff").otherwise("note")
    rows = v.changes(spark, d).withColumn("kind", kind).withColumn("body", body)
    return f.visible_to(rows, "7").select("seq")


@query(
    "p11_slim_facts",
    sql(f"""SELECT id, fact_type, source_id, greatest(1, floor(({NOW} - created_at) / 86400000.0)::BIGINT) AS age_days,
CASE WHEN greatest(1, floor(({NOW} - created_at) / 86400000.0)::BIGINT) >= 60
THEN greatest(1, floor(({NOW} - created_at) / 86400000.0)::BIGINT) || ' days old: verify before use' END AS warning FROM facts"""),
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    return f.slim_facts(v.facts(spark, d), NOW).drop("content")


@query("p12_slim_entities", sql("""SELECT name, entity_type, coalesce(n, 0) AS fact_count, array_to_string(list_sort(tags), ',') AS tags FROM entities
LEFT JOIN (SELECT entity_id, count(*) AS n FROM fact_entities GROUP BY 1) ON entity_id = id"""))
def p12(spark: SparkSession, d: str) -> DataFrame:
    rows = a.entity_counts(v.entities(spark, d), v.fact_entities(spark, d))
    return rows.select("name", "entity_type", "fact_count", F.array_join(F.sort_array("tags"), ",").alias("tags"))


@query("p13_preview", sql("SELECT id, CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || '…' ELSE content END AS preview FROM texts"))
def p13(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).select("id", f.shortened(F.col("content"), 80).alias("preview"))


@query("p14_relative_window", sql(f"SELECT id FROM facts WHERE coalesce(observed_at, created_at) >= {NOW - 45 * f.DAY}"))
def p14(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).where(f.in_window(f.window_start(NOW, "45d", since=T0))).select("id")


@query("p15_fact_type_argument", sql("SELECT id FROM facts WHERE fact_type = 'error'"))
def p15(spark: SparkSession, d: str) -> DataFrame:
    return f.fact_list(v.facts(spark, d), f.parse_fact_type(" Errors ")).select("id")


@query(
    "p16_personalisation",
    sql("""SELECT id, fact_type, pos FROM (SELECT *, row_number() OVER (PARTITION BY fact_type ORDER BY id) AS pos FROM facts
WHERE fact_type IN ('signup', 'error', 'click') AND superseded_at IS NULL) WHERE pos <= 4"""),
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    return f.first_per_type(v.facts(spark, d), ["signup", "error", "click"], 4).select("id", "fact_type", "pos")


COUNTS = "counts AS (SELECT entity_id, count(*) AS n FROM fact_entities GROUP BY 1)"


@query("j1_entity_facts", sql("SELECT e.id AS entity_id, e.name, b.fact_id FROM entities e JOIN fact_entities b ON b.entity_id = e.id WHERE e.entity_type = 'supplier'"))
def j1(spark: SparkSession, d: str) -> DataFrame:
    e = v.entities(spark, d).where("entity_type = 'supplier'").select(F.col("id").alias("entity_id"), "name")
    return e.join(v.fact_entities(spark, d), "entity_id")


@query("j2_entity_names", sql("""SELECT fact_id, string_agg(e.name, '; ' ORDER BY entity_id) AS names FROM fact_entities
JOIN entities e ON e.id = entity_id GROUP BY fact_id"""))
def j2(spark: SparkSession, d: str) -> DataFrame:
    return a.entity_names(v.fact_entities(spark, d), v.entities(spark, d))


@query("j3_tag_joins", sql("""SELECT DISTINCT e.id FROM entities e, unnest(e.tags) t(x), unnest(e.tags) u(y) WHERE x = 'FURNITURE' AND y = 'nation7'"""))
def j3(spark: SparkSession, d: str) -> DataFrame:
    return a.by_tag_joins(v.entities(spark, d), ["FURNITURE", "nation7"])


@query("j9_mailbox", sql("""SELECT seq, id, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM changes)
WHERE n = 1 AND operation = 'upsert' AND actor_id = 'purchase'"""))
def j9(spark: SparkSession, d: str) -> DataFrame:
    latest = a.latest(v.changes(spark, d), ["id"], [F.desc("seq")])
    return latest.where("operation = 'upsert' AND actor_id = 'purchase'").select("seq", "id", "body")


@query("j10_missing_edges", sql("""SELECT DISTINCT 'part:' || l_partkey AS source_id, 'nation:' || s_nationkey AS target_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.source_id = 'part:' || l_partkey AND r.target_id = 'nation:' || s_nationkey)"""))
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Candidate edges part to nation, without those that exist."""
    items, sup = v.table(spark, d, "lineitem"), v.table(spark, d, "supplier")
    new = items.join(sup, items.l_suppkey == sup.s_suppkey).select(
        F.concat(F.lit("part:"), "l_partkey").alias("source_id"), F.concat(F.lit("nation:"), "s_nationkey").alias("target_id")
    )
    return a.without_existing(new.distinct(), v.relations(spark, d), ["source_id", "target_id"])


@query("j11_entity_pairs", sql("""SELECT a.entity_id AS source_id, b.entity_id AS target_id, count(*) AS n FROM fact_entities a JOIN fact_entities b USING (fact_id)
WHERE a.entity_id < b.entity_id GROUP BY 1, 2"""))
def j11(spark: SparkSession, d: str) -> DataFrame:
    return a.co_mentions(v.fact_entities(spark, d))


@query("j15_garbage", sql(f"""SELECT f.id FROM facts f WHERE f.created_at <= {T0} AND NOT f.pinned
AND NOT EXISTS (SELECT 1 FROM facts x WHERE x.entity = f.entity AND x.fact_type = 'signup' AND x.superseded_at IS NULL AND x.created_at > {T0 + 60 * f.DAY})
AND NOT EXISTS (SELECT 1 FROM facts y WHERE y.superseded_by = f.id)
AND NOT EXISTS (SELECT 1 FROM facts z WHERE z.entity = f.entity AND z.fact_type = 'error' AND z.created_at > f.created_at AND z.superseded_at IS NULL AND z.pinned)"""))
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Due rows that no path, no reservation and no later read holds back."""
    x = v.facts(spark, d)
    due = x.where((F.col("created_at") <= T0) & ~F.col("pinned"))
    path = x.where(f"fact_type = 'signup' AND superseded_at IS NULL AND created_at > {T0 + 60 * f.DAY}").select("entity")
    reserved = x.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id"))
    read = x.where("fact_type = 'error' AND superseded_at IS NULL AND pinned").select(F.col("entity").alias("e"), F.col("created_at").alias("read_at"))
    left = due.join(path, "entity", "left_anti").join(reserved, "id", "left_anti")
    return left.join(read, (F.col("entity") == F.col("e")) & (F.col("read_at") > F.col("created_at")), "left_anti").select("id")


@query("a1_facts_per_entity", sql("SELECT entity_id, count(*) AS fact_count FROM fact_entities GROUP BY 1"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return v.fact_entities(spark, d).groupBy("entity_id").agg(F.count("*").alias("fact_count"))


@query("a2_scoped_facts_per_entity", sql("SELECT entity, count(*) AS fact_count FROM facts WHERE source_id = 'ns4' GROUP BY 1"))
def a2(spark: SparkSession, d: str) -> DataFrame:
    return f.fact_list(v.facts(spark, d), source_id="ns4").groupBy("entity").agg(F.count("*").alias("fact_count"))


@query("a3_stats", sql("""SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM entities) AS entities,
(SELECT count(*) FROM relations) AS relations, (SELECT max(created_at) FROM facts) AS last_ingest"""))
def a3(spark: SparkSession, d: str) -> DataFrame:
    return a.stats(v.facts(spark, d), v.entities(spark, d), v.relations(spark, d))


@query("a4_overview_entity_types", sql("""SELECT entity_type, count(*) AS n, string_agg(CASE WHEN k <= 3 THEN name END, '; ' ORDER BY k) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY name, id) AS k FROM entities) GROUP BY 1"""))
def a4(spark: SparkSession, d: str) -> DataFrame:
    return a.type_buckets(v.entities(spark, d), 3)


@query("a4_overview_facts", sql(f"""SELECT fact_type, count(*) AS n, count(*) FILTER (superseded_at IS NULL) AS n_current, count(*) FILTER (pinned) AS n_pinned,
count(*) FILTER (created_at >= {NOW - 30 * f.DAY}) AS n_recent FROM facts GROUP BY 1"""))
def a4f(spark: SparkSession, d: str) -> DataFrame:
    return a.fact_buckets(v.facts(spark, d), NOW - 30 * f.DAY)


@query("a5_aggregate_count", sql("SELECT count(*) FILTER (fact_type = 'click') AS matched, count(*) AS considered FROM facts WHERE source_id = 'ns1'"))
def a5(spark: SparkSession, d: str) -> DataFrame:
    hits = f.fact_list(v.facts(spark, d), source_id="ns1")
    return hits.agg(F.count_if(F.col("fact_type") == "click").alias("matched"), F.count("*").alias("considered"))


@query("a6_aggregate_enumerate", sql("SELECT id, substr(content, 1, 8) || CASE WHEN length(content) > 8 THEN '…' ELSE '' END AS preview FROM facts WHERE fact_type = 'signup'"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    return f.fact_list(v.facts(spark, d), "signup").select("id", f.shortened(F.col("content"), 8).alias("preview"))


@query("a7_aggregate_by_entity", sql("""SELECT coalesce(entity, '(no entity)') AS entity, count(*) AS n, string_agg(DISTINCT fact_type, ',' ORDER BY fact_type) AS types,
max(source_confidence) AS best FROM facts GROUP BY 1"""))
def a7(spark: SparkSession, d: str) -> DataFrame:
    return a.by_entity(v.facts(spark, d), "entity", "source_confidence")


@query("a14_pending_stats", sql("""SELECT fact_type, count(*) AS n, min(source_confidence) AS low, avg(source_confidence) AS mean, max(source_confidence) AS high,
count(*) FILTER (source_confidence < 0.5) AS b0, count(*) FILTER (source_confidence >= 0.5 AND source_confidence < 0.7) AS b1,
count(*) FILTER (source_confidence >= 0.7 AND source_confidence < 0.9) AS b2, count(*) FILTER (source_confidence >= 0.9) AS b3 FROM facts GROUP BY 1""".replace("avg(source_confidence)", "round(avg(source_confidence), 9)")))
def a14(spark: SparkSession, d: str) -> DataFrame:
    return a.pending_stats(v.facts(spark, d))


@query("a15_coverage", sql("""SELECT fact_type, source_id, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total,
sum(count(*) FILTER (source_id IS NULL OR fact_type IS NULL)) OVER ()::BIGINT AS blank FROM facts GROUP BY 1, 2"""))
def a15(spark: SparkSession, d: str) -> DataFrame:
    return a.coverage(v.facts(spark, d), ["fact_type", "source_id"])


@query("a16_group_by_entity", sql("SELECT entity_id, count(*) AS n, min(fact_id) AS first_fact FROM fact_entities GROUP BY 1"))
def a16(spark: SparkSession, d: str) -> DataFrame:
    rows = v.fact_entities(spark, d).groupBy("fact_id").agg(F.collect_set("entity_id").alias("names"))
    return a.multi_membership(rows).agg(F.count("*").alias("n"), F.min("fact_id").alias("first_fact"))


@query("a17_dedupe_by_fact", sql("SELECT content, min(id) AS id FROM facts GROUP BY 1"))
def a17(spark: SparkSession, d: str) -> DataFrame:
    return a.latest(v.facts(spark, d), ["content"], [F.col("id")]).select("content", "id")


@query("a22_session_blocks", sql("""SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS block FROM conversations
WHERE conv_id IN (SELECT conv_id FROM conversations WHERE length(text) > 400) GROUP BY 1"""))
def a22(spark: SparkSession, d: str) -> DataFrame:
    t = v.table(spark, d, "conversations")
    return a.session_blocks(t, t.where("length(text) > 400").select("conv_id"))


@query("a23_profile", sql("""SELECT fact_type, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY fact_type ORDER BY source_confidence DESC, id) AS pos
FROM facts WHERE superseded_at IS NULL) WHERE pos <= 20"""))
def a23(spark: SparkSession, d: str) -> DataFrame:
    return a.top_per(v.facts(spark, d).where(f.current()), ["fact_type"], [F.desc("source_confidence"), F.col("id")], 20).select("fact_type", "id", "pos")


@query("a23_profile_entities", sql("""SELECT entity, n FROM (SELECT entity, count(*) AS n FROM facts GROUP BY 1) ORDER BY n DESC, entity LIMIT 12"""))
def a23e(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(12)


@query("a27_fingerprint", sql("""SELECT relation_type, sha256(string_agg(digest, ',' ORDER BY chunk)) AS fingerprint FROM (
SELECT relation_type, chunk, sha256(string_agg(source_id || '>' || target_id, ',' ORDER BY source_id, target_id)) AS digest FROM (
SELECT *, (row_number() OVER (PARTITION BY relation_type ORDER BY source_id, target_id) - 1) // 1000 AS chunk FROM relations) GROUP BY 1, 2) GROUP BY 1"""))
def a27(spark: SparkSession, d: str) -> DataFrame:
    return a.ordered_fingerprint(v.relations(spark, d))


@query("w2_examples_per_type", sql("SELECT entity_type, name, pos FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY updated_at DESC, id) AS pos FROM entities) WHERE pos <= 5"))
def w2(spark: SparkSession, d: str) -> DataFrame:
    return a.top_per(v.entities(spark, d), ["entity_type"], [F.desc("updated_at"), F.col("id")], 5).select("entity_type", "name", "pos")


@query("w4_latest_facts", sql("SELECT entity, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, id DESC) AS pos FROM facts) WHERE pos <= 3"))
def w4(spark: SparkSession, d: str) -> DataFrame:
    return a.top_per(v.facts(spark, d), ["entity"], [F.desc("created_at"), F.desc("id")], 3).select("entity", "id", "pos")


@query("t4_entity_sorts", sql("""SELECT id, fact_count FROM (SELECT id, coalesce(n, 0) AS fact_count FROM entities LEFT JOIN counts ON entity_id = id)
ORDER BY fact_count DESC, id LIMIT 50""", COUNTS))
def t4(spark: SparkSession, d: str) -> DataFrame:
    rows = a.entity_counts(v.entities(spark, d), v.fact_entities(spark, d))
    return f.page(rows, [F.desc("fact_count"), F.col("id")], 50).select("id", "fact_count")


@query("t5_offset_paging", sql("SELECT id, created_at FROM facts WHERE fact_type = 'view' ORDER BY id LIMIT 25 OFFSET 100"))
def t5(spark: SparkSession, d: str) -> DataFrame:
    return f.page(f.fact_list(v.facts(spark, d), "view"), [F.col("id")], 25, 100).select("id", "created_at")


@query("t6_pinned", sql("SELECT id, created_at FROM facts WHERE pinned AND source_id = 'ns1' ORDER BY created_at DESC, id LIMIT 20"))
def t6(spark: SparkSession, d: str) -> DataFrame:
    rows = f.fact_list(v.facts(spark, d), source_id="ns1").where("pinned")
    return f.page(rows, [F.desc("created_at"), F.col("id")], 20).select("id", "created_at")


@query("t9_keyset_paging", sql("SELECT seq, id FROM changes WHERE seq < 5000 ORDER BY seq DESC LIMIT 21"))
def t9(spark: SparkSession, d: str) -> DataFrame:
    return f.page(v.changes(spark, d).where("seq < 5000"), [F.desc("seq")], 21).select("seq", "id")


@query("t10_size_budget", sql("""SELECT id, pos FROM (SELECT *, sum(length(p)) OVER (ORDER BY pos) AS upto FROM (SELECT id, substr(content, 1, 200) AS p,
row_number() OVER (ORDER BY id DESC) AS pos FROM texts) WHERE pos <= 100) WHERE upto <= 8000"""))
def t10(spark: SparkSession, d: str) -> DataFrame:
    top = v.texts(spark, d).orderBy(F.desc("id")).limit(100)
    rows = f.fit_budget(top, F.length(F.substring("content", 1, 200)), 8000, [F.desc("id")])
    return a.renumbered(rows, [F.desc("id")], "pos").select("id", "pos")


@query("recent", sql(f"SELECT id, created_at FROM facts WHERE coalesce(observed_at, created_at) >= {NOW - 60 * f.DAY} ORDER BY id LIMIT 30"))
def recent(spark: SparkSession, d: str) -> DataFrame:
    """Oldest first inside the window."""
    rows = v.facts(spark, d).where(f.in_window(f.window_start(NOW, "60d")))
    return f.page(rows, [F.col("id")], 30).select("id", "created_at")


@query("u1_hot_cold_union", sql("SELECT id, 0 AS tier FROM facts WHERE superseded_at IS NULL UNION ALL SELECT id, 1 FROM facts WHERE superseded_at IS NOT NULL AND created_at >= 1709000000000"))
def u1(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d)
    cold = facts.where("created_at >= 1709000000000")
    return f.prefer(facts.where(f.current()).select("id", F.lit(0).alias("tier")), cold.select("id", F.lit(1).alias("tier")))


@query("u2_union_by_name", sql("SELECT DISTINCT entity FROM facts WHERE fact_type IN ('signup', 'error')"))
def u2(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d)
    return facts.where("fact_type = 'signup'").select("entity").union(facts.where("fact_type = 'error'").select("entity")).distinct()


@query("u3_difference", sql("SELECT DISTINCT target_id AS id FROM relations WHERE target_id NOT IN (SELECT source_id FROM relations)"))
def u3(spark: SparkSession, d: str) -> DataFrame:
    r = v.relations(spark, d)
    return r.select(F.col("target_id").alias("id")).distinct().join(r.select(F.col("source_id").alias("id")), "id", "left_anti")


@query("u4_record_diff", sql(f"""SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN a.entity IS NULL THEN 'new' WHEN b.entity IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM (SELECT entity, max(id) AS h FROM facts WHERE created_at <= {T0} GROUP BY 1) a FULL JOIN (SELECT entity, max(id) AS h FROM facts WHERE created_at <= {NOW} GROUP BY 1) b
ON a.entity = b.entity WHERE a.h IS DISTINCT FROM b.h"""))
def u4(spark: SparkSession, d: str) -> DataFrame:
    last = lambda t: v.facts(spark, d).where(F.col("created_at") <= t).groupBy("entity").agg(F.max("id").alias("h"))
    return a.record_diff(last(T0), last(NOW), "entity")


@query("u5_tag_intersection", sql("SELECT id, array_to_string(list_sort(list_intersect(tags, ['MACHINERY', 'nation1', 'nation2', 'place'])), ',') AS shared FROM entities WHERE len(list_intersect(tags, ['MACHINERY', 'nation1', 'nation2', 'place'])) > 0"))
def u5(spark: SparkSession, d: str) -> DataFrame:
    shared = F.array_intersect("tags", F.array(*map(F.lit, ["MACHINERY", "nation1", "nation2", "place"])))
    return v.entities(spark, d).where(F.size(shared) > 0).select("id", F.array_join(F.sort_array(shared), ",").alias("shared"))


@query("u8_first_wins_union", sql("""SELECT id, list, row_number() OVER (PARTITION BY list ORDER BY id) AS pos FROM (SELECT id, min(list) AS list FROM (
SELECT id, 0 AS list FROM facts WHERE fact_type = 'signup' AND source_id = 'ns1' UNION ALL SELECT id, 1 FROM facts WHERE source_id = 'ns1' AND pinned) GROUP BY id)"""))
def u8(spark: SparkSession, d: str) -> DataFrame:
    facts = f.fact_list(v.facts(spark, d), source_id="ns1")
    lists = [facts.where("fact_type = 'signup'"), facts.where("pinned")]
    return a.first_wins(lists, "id")
