"""Queries of writes, consolidation and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import views as v
from factlake.operators import lifecycle as c
from factlake.operators import lint, similarity
from factlake.plans.registry import query
from factlake.staging import new_dir
from factlake.streaming import leases
from factlake.views import sql

NOW = 1_710_000_000_000


def _fact_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d)
    return rows.select("id", "content", "source_id", F.array("entity").alias("entity_ids"), F.col("created_at").alias("updated_at"))


@query("l1_insert_dedup", sql("""SELECT min(id) AS id, content, source_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM facts GROUP BY content, source_id"""))
def l1(spark: SparkSession, d: str) -> DataFrame:
    rows = _fact_rows(spark, d)
    facts, _ = c.insert(rows.limit(0), rows)
    return facts.select("id", "content", "source_id", F.array_join("entity_ids", ",").alias("entities"))


@query("l1_insert_receipts", sql("SELECT id, min(id) OVER (PARTITION BY content, source_id) AS stored_id, id <> min(id) OVER (PARTITION BY content, source_id) AS merged FROM facts"))
def l1r(spark: SparkSession, d: str) -> DataFrame:
    rows = _fact_rows(spark, d)
    return c.insert(rows.limit(0), rows)[1]


@query("l3_conflict_resolution", sql("""SELECT id, CASE WHEN live AND n > 1 THEN w ELSE superseded_by END AS superseded_by FROM (SELECT *, row_number() OVER p AS n, first_value(id) OVER p AS w FROM (
SELECT *, superseded_at IS NULL AND fact_type IN ('signup', 'purchase') AS live FROM facts) WINDOW p AS (PARTITION BY entity, fact_type, source_id, live ORDER BY created_at DESC, id DESC))"""))
def l3(spark: SparkSession, d: str) -> DataFrame:
    return c.resolve_conflicts(v.facts(spark, d), ["signup", "purchase"]).select("id", "superseded_by")


@query("l4_supersede", sql("SELECT id, CASE WHEN superseded_at IS NULL AND fact_type = 'view' THEN 0 ELSE superseded_by END AS superseded_by FROM facts"))
def l4(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d)
    pairs = facts.where("fact_type = 'view'").select(F.col("id").alias("old_id"), F.lit(0).cast("long").alias("new_id"))
    return c.supersede(facts, pairs, NOW)[0].select("id", "superseded_by")


@query("l4_supersede_errors", sql("SELECT id, superseded_by FROM facts WHERE fact_type = 'view' AND superseded_at IS NOT NULL"))
def l4e(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d)
    pairs = facts.where("fact_type = 'view'").select(F.col("id").alias("old_id"), F.lit(0).cast("long").alias("new_id"))
    return c.supersede(facts, pairs, NOW)[1]


@query("l5_expired", sql(f"SELECT id FROM facts WHERE superseded_at IS NULL AND ((fact_type = 'view' AND created_at + 10 * 86400000::BIGINT < {NOW}) OR (fact_type = 'click' AND created_at + 40 * 86400000::BIGINT < {NOW}))"))
def l5t(spark: SparkSession, d: str) -> DataFrame:
    return c.expired(v.facts(spark, d), {"view": 10, "click": 40}, NOW).select("id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, and of each a newer copy with every other component shrunk, more or less alike."""
    e = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("ns"), F.col("embedding").cast("array<double>").alias("v"))
    shrink = F.element_at(F.array(F.lit(0.6), F.lit(0.2), F.lit(0.9)), (F.col("id") % 3 + 1).cast("int"))
    copies = e.withColumn("v", F.transform("v", lambda x, i: F.when(i % 2 == 0, x * shrink).otherwise(x))).withColumn("id", F.col("id") + 1_000_000_000)
    return e.unionByName(copies)


SIM = """vecs AS (SELECT vec_id AS id, label AS ns, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000000, label,
list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i % 2 = 1 THEN x * [0.6, 0.2, 0.9][vec_id % 3 + 1] ELSE x END) FROM embeddings),
sims AS (SELECT a.id AS a, b.id AS b FROM vecs a JOIN vecs b ON a.ns = b.ns AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.85)"""
CLUSTERS = """flood(node, other) AS (SELECT a, a FROM sims UNION SELECT b, b FROM sims UNION SELECT CASE WHEN s.a = node THEN s.b ELSE s.a END, other FROM flood JOIN sims s ON s.a = node OR s.b = node),
members AS (SELECT node AS id, min(other) AS cluster FROM flood GROUP BY 1),
totals AS (SELECT m.id, m.cluster, count(*) + 1 AS size, round(sum(1 - list_cosine_similarity(x.v, y.v)), 9) AS total FROM members m JOIN vecs x ON x.id = m.id JOIN members n ON n.cluster = m.cluster AND n.id <> m.id JOIN vecs y ON y.id = n.id GROUP BY 1, 2),
placed AS (SELECT *, sum(total) OVER p / (size * (size - 1)) < 1 - 0.85 AS tight, id = max(id) OVER p AS newest, row_number() OVER (PARTITION BY cluster ORDER BY total, id) = 1 AS medoid,
row_number() OVER (PARTITION BY cluster ORDER BY total DESC, id) <= 1 AS far FROM totals WINDOW p AS (PARTITION BY cluster))"""


@query("j7_similar_pairs", sql("SELECT a, b FROM sims", SIM))
def j7(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_pairs(_vectors(spark, d), 0.85).select("a", "b")


@query("l5_semantic_dedup", sql("SELECT a AS id, min(b) AS superseded_by FROM sims GROUP BY 1", SIM))
def l5(spark: SparkSession, d: str) -> DataFrame:
    return c.semantic_dedup(_vectors(spark, d), 0.85)


@query("l6_consolidate", sql("SELECT id, cluster, size, tight, CASE WHEN tight THEN newest ELSE medoid OR far END AS keep FROM placed", SIM, CLUSTERS))
def l6(spark: SparkSession, d: str) -> DataFrame:
    return c.consolidate(_vectors(spark, d), 0.85, budget=1)


@query("l7_archive", sql("SELECT id, superseded_at IS NOT NULL AS cold FROM facts"))
def l7(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d).select("id", "superseded_at")
    hot, cold = c.archive(facts, facts.limit(0), facts.where("superseded_at IS NOT NULL").select("id"))
    return hot.select("id", F.lit(False).alias("cold")).unionByName(cold.select("id", F.lit(True).alias("cold")))


@query("l8_delete", sql("SELECT id FROM facts WHERE fact_type <> 'error'"))
def l8(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d)
    return c.delete(facts, facts.where("fact_type = 'error'").select("id")).select("id")


@query("l9_feedback", sql("""SELECT id, round(list_reduce(list_prepend(0.5::DOUBLE, steps), lambda s, x: greatest(0.0, least(1.0, s + x))), 6) AS relevance_score FROM (
SELECT user_id AS id, list(CASE WHEN value > 10 THEN 0.1 ELSE -0.15 END::DOUBLE ORDER BY event_id) AS steps FROM events WHERE event_type = 'click' GROUP BY 1)"""))
def l9(spark: SparkSession, d: str) -> DataFrame:
    votes = v.table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("fact_id"), (F.col("value") > 10).alias("helpful"), F.col("event_id").alias("at"))
    return c.feedback(votes.select(F.col("fact_id").alias("id")).distinct(), votes)


@query("l10_pin", sql("SELECT id, pinned OR fact_type = 'signup' AS pinned FROM facts"))
def l10(spark: SparkSession, d: str) -> DataFrame:
    return v.facts(spark, d).select("id", (F.col("pinned") | (F.col("fact_type") == "signup")).alias("pinned"))


@query("l12_resolve_entities", sql("""SELECT wanted, coalesce(id, 'new:' || left(sha256(lower(wanted)), 16)) AS id, id IS NULL AS created FROM (SELECT DISTINCT event_type AS wanted FROM events UNION SELECT n_name FROM nation)
LEFT JOIN (SELECT lower(name) AS low, min(id) AS id FROM entities GROUP BY 1) ON low = lower(wanted)"""))
def l12(spark: SparkSession, d: str) -> DataFrame:
    names = v.table(spark, d, "events").select(F.col("event_type").alias("wanted")).union(v.table(spark, d, "nation").select("n_name"))
    return c.resolve_entities(names, v.entities(spark, d))


@query("l14_vector_rebuild", sql("SELECT d.doc_id AS id, e.vec_id IS NULL AS to_embed FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"))
def l14(spark: SparkSession, d: str) -> DataFrame:
    """Cached vectors are reused; texts without one are left to embed."""
    cached = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("has"))
    return v.texts(spark, d).select("id").join(cached, "id", "left").select("id", F.col("has").isNull().alias("to_embed"))


def _handoff_events(spark: SparkSession, d: str) -> DataFrame:
    """Users' events play handoffs: a sign-up dispatches, a click accepts, views keep alive, a purchase returns."""
    action = F.create_map(*[F.lit(x) for kv in {"signup": "dispatch", "click": "accept", "view": "heartbeat", "purchase": "return"}.items() for x in kv])
    e = v.table(spark, d, "events").where("event_type <> 'error'")
    return e.select(F.col("user_id").alias("id"), v.millis("ts").alias("at"), F.col("event_id").alias("seq"), action[F.col("event_type")].alias("action"), F.lit("agent").alias("actor"))


#: The fold of each handoff's events, as one list per handoff.
HANDOFFS = """ev AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS t, event_id AS seq, CASE event_type WHEN 'signup' THEN 'dispatch' WHEN 'click' THEN 'accept' WHEN 'view' THEN 'heartbeat' ELSE 'return' END AS action
FROM events WHERE event_type <> 'error'),
folded AS (SELECT id, list_reduce(list({'t': t, 'action': action, 'state': '', 'holder': NULL::VARCHAR, 'revision': 0, 'expires': NULL::BIGINT} ORDER BY t, seq), lambda s, e: CASE
WHEN e.action = 'dispatch' AND s.state = 'none' THEN {'t': e.t, 'action': '', 'state': 'pending', 'holder': NULL, 'revision': s.revision + 1, 'expires': NULL}
WHEN e.action = 'accept' AND (s.state = 'pending' OR (s.state = 'accepted' AND NOT coalesce(s.expires > e.t, false))) THEN {'t': e.t, 'action': '', 'state': 'accepted', 'holder': 'agent', 'revision': s.revision + 1, 'expires': e.t + 86400000}
WHEN e.action = 'heartbeat' AND s.state = 'accepted' AND coalesce(s.expires > e.t, false) THEN {'t': e.t, 'action': '', 'state': s.state, 'holder': s.holder, 'revision': s.revision + 1, 'expires': e.t + 86400000}
WHEN e.action = 'return' AND s.state = 'accepted' THEN {'t': e.t, 'action': '', 'state': 'completed', 'holder': s.holder, 'revision': s.revision + 1, 'expires': NULL} ELSE s END,
{'t': 0::BIGINT, 'action': '', 'state': 'none', 'holder': NULL::VARCHAR, 'revision': 0, 'expires': NULL::BIGINT}) AS s FROM ev GROUP BY id),
handoffs AS (SELECT id, s.state AS state, s.holder AS holder, s.revision AS revision, CASE WHEN s.state = 'pending' THEN 'ready' WHEN s.state = 'completed' THEN 'returned' WHEN s.state = 'accepted' AND s.expires <= 1710000000000 THEN 'attention'
WHEN s.state = 'accepted' THEN 'in_progress' ELSE 'none' END AS lane FROM folded)"""


@query("l16_handoff_states", sql("SELECT id, state, holder, revision, lane FROM handoffs", HANDOFFS))
def l16(spark: SparkSession, d: str) -> DataFrame:
    return c.handoff_states(_handoff_events(spark, d), NOW, 86_400_000)


@query("a24_handoff_board", sql("SELECT lane, count(*) AS n FROM handoffs GROUP BY 1", HANDOFFS))
def a24(spark: SparkSession, d: str) -> DataFrame:
    return c.board(c.handoff_states(_handoff_events(spark, d), NOW, 86_400_000))


#: The same fold, in which every eleventh event counts only at revision 0.
SWAPS = HANDOFFS
for _old, _new in {
    "event_id AS seq, CASE": "event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 0 END AS expected, CASE", "{'t': t, ": "{'t': t, 'expected': expected, ", "{'t': e.t, ": "{'t': e.t, 'expected': NULL, ",
    "{'t': 0::BIGINT, ": "{'t': 0::BIGINT, 'expected': NULL::INTEGER, ", "WHEN e.action": "WHEN coalesce(e.expected = s.revision, true) AND e.action",
}.items():
    SWAPS = SWAPS.replace(_old, _new)


@query("l16_lease_stream", sql("SELECT id, state, holder, revision, lane FROM handoffs", SWAPS))
def l16s(spark: SparkSession, d: str) -> DataFrame:
    """The events as files out of order, with repeats; the stream is stopped half-way and started again from its checkpoint."""
    log, done = new_dir(spark, "lease-log"), new_dir(spark, "lease-checkpoint")
    rows = _handoff_events(spark, d).withColumns({"expected": F.when(F.col("seq") % 11 == 0, 0), "ts": F.timestamp_millis("at"), "file": F.pmod(F.xxhash64("seq"), F.lit(4)).cast("int")})
    again = rows.where("seq % 5 = 0").withColumn("file", F.lit(4))
    parts = rows.unionByName(again)
    schema = "id long, at long, seq long, action string, actor string, expected int, ts timestamp"
    parts = parts.select(F.col("id").cast("long"), "at", F.col("seq").cast("long"), "action", "actor", F.col("expected").cast("int"), "ts", "file")
    table = leases.LeaseTable(spark)
    for files in ("file IN (0, 4)", "file IN (1, 2, 3)"):
        parts.where(files).drop("file").write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(log)
        leases.follow_leases(stream, table, done, 86_400_000, "4000 days").awaitTermination()
    return table.table(NOW)


@query("l17_inbox", sql("SELECT entity, id FROM facts WHERE source_id = 'ns2' AND fact_type = 'signup' ORDER BY created_at DESC, id DESC LIMIT 25"))
def l17(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).where("source_id = 'ns2' AND fact_type = 'signup'")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(25).select("entity", "id")


WITH_BRANDS = "listed AS (SELECT id, name, entity_type, updated_at FROM entities UNION ALL SELECT DISTINCT 'brand:' || p_brand, p_brand, 'brand', 0::BIGINT FROM part)"
ORPHANS = "orphans AS (SELECT id FROM listed WHERE id NOT IN (SELECT source_id FROM relations UNION SELECT target_id FROM relations UNION SELECT entity_id FROM fact_entities))"


def _with_brands(spark: SparkSession, d: str) -> DataFrame:
    """Entities, and the brands of parts, which nothing links to."""
    brands = v.table(spark, d, "part").select(F.concat(F.lit("brand:"), "p_brand").alias("id"), F.col("p_brand").alias("name"), F.lit("brand").alias("entity_type"), F.lit(0).cast("long").alias("updated_at"))
    return v.entities(spark, d).select("id", "name", "entity_type", "updated_at").unionByName(brands.distinct())


@query("i1_orphans", sql("SELECT id FROM orphans", WITH_BRANDS, ORPHANS))
def i1(spark: SparkSession, d: str) -> DataFrame:
    return lint.orphans(_with_brands(spark, d), v.relations(spark, d), v.fact_entities(spark, d)).select("id")


GRAMS = r"""names AS (SELECT entity_type, lower(name) AS low, min(id) AS id, list_distinct(list_transform(range(1, length(min(name)) + 3), lambda i: substr('  ' || lower(min(name)) || '  ', i, 3))) AS g FROM entities GROUP BY 1, 2),
ex AS (SELECT entity_type, id, len(g) AS n, unnest(g) AS t FROM names),
shared AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS an, b.n AS bn, count(*) AS s FROM ex a JOIN ex b ON a.entity_type = b.entity_type AND a.t = b.t AND a.id < b.id GROUP BY 1, 2, 3, 4)"""


@query("i2_duplicates", sql("SELECT a_id, b_id, round(s / (an + bn - s)::DOUBLE, 6) AS similarity FROM shared WHERE s >= 4 AND least(an, bn) >= 0.8 * greatest(an, bn) AND s / (an + bn - s)::DOUBLE > 0.8", GRAMS))
def i2(spark: SparkSession, d: str) -> DataFrame:
    return lint.duplicates(v.entities(spark, d), ratio=0.8, similarity=0.8).select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query("i3_stale", sql("SELECT id FROM entities WHERE updated_at < 100"))
def i3(spark: SparkSession, d: str) -> DataFrame:
    return lint.stale(v.entities(spark, d), 200, 100).select("id")


CONFLICTS = """conflicts AS (SELECT entity, fact_type, count(*) AS n, array_to_string(list(id ORDER BY id)[1:3], ',') AS first_ids FROM facts
WHERE superseded_at IS NULL AND fact_type IN ('signup', 'purchase', 'click') GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _events_as_rulings(spark: SparkSession, d: str) -> DataFrame:
    """Facts of which only every third keeps what superseded it, so that current ones clash."""
    facts = v.facts(spark, d)
    return facts.withColumn("superseded_at", F.when(F.col("id") % 3 == 0, F.col("superseded_at")))


RULINGS = "rulings AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN superseded_at END AS superseded_at) FROM facts)"


@query("i4_conflicts", sql("SELECT * FROM conflicts", RULINGS, CONFLICTS.replace("FROM facts", "FROM rulings")))
def i4(spark: SparkSession, d: str) -> DataFrame:
    found = lint.conflicts(_events_as_rulings(spark, d), ["signup", "purchase", "click"])
    return found.withColumn("first_ids", F.array_join("first_ids", ","))


@query("a13_lint_rollup", sql("""SELECT 'orphan' AS code, count(*) AS n FROM orphans UNION ALL SELECT 'conflict', count(*) FROM conflicts
UNION ALL SELECT 'stale', count(*) FROM listed WHERE updated_at < 1000 UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM shared WHERE s >= 4 AND least(an, bn) >= 0.9 * greatest(an, bn) AND s / (an + bn - s)::DOUBLE > 0.9) HAVING count(*) > 0""",
    WITH_BRANDS, ORPHANS, RULINGS, CONFLICTS.replace("FROM facts", "FROM rulings"), GRAMS.replace("FROM entities", "FROM listed")))
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Issues of all four checks by code."""
    now = 1000 + 90 * 86_400_000
    found = lint.report(_with_brands(spark, d), v.relations(spark, d), v.fact_entities(spark, d), _events_as_rulings(spark, d), now, ["signup", "purchase", "click"])
    return lint.rollup(found)
