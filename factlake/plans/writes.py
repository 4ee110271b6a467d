"""Queries of the write path, entity edits, reviews, mined edges and service rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake import views as v
from factlake.functions import text as x
from factlake.operators import aggregates as a
from factlake.operators import filters as f
from factlake.operators import graph as g
from factlake.operators import lifecycle as life
from factlake.operators import ranking as r
from factlake.operators import service as s
from factlake.operators import writes as w
from factlake.plans.registry import query
from factlake.plans.text import MEMOS, memos
from factlake.sources import interchange
from factlake.views import sql

NOW = 1_710_000_000_000
NOTES = r"""notes AS (SELECT conv_id * 1000 + turn AS id, text AS content, role AS source_id, 'conv:' || conv_id AS entity FROM conversations),
ntok AS (SELECT id, source_id, unnest(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM notes),
nlen AS (SELECT id, count(*) AS len FROM ntok GROUP BY 1),
nstat AS (SELECT count(*) AS n, avg(coalesce(len, 0)) AS avgdl FROM notes LEFT JOIN nlen USING (id)),
ntf AS (SELECT id, source_id, term, count(*) AS tf FROM ntok GROUP BY 1, 2, 3),
nidf AS (SELECT term, ln(1 + ((SELECT n FROM nstat) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM ntf GROUP BY 1),
nhits AS (SELECT q.id AS query_id, d.id, q.source_id, round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
FROM ntf q JOIN ntf d ON q.term = d.term AND q.source_id = d.source_id JOIN nidf ON nidf.term = q.term JOIN nlen ON nlen.id = d.id, nstat GROUP BY 1, 2, 3)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as facts on their conversation, in the namespace of their role."""
    c = v.table(spark, d, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.col("role").alias("source_id"),
        F.concat(F.lit("conv:"), "conv_id").alias("entity"), F.lit(None).cast("long").alias("superseded_at"),
    )


@query("g6_mined_by_content", sql("""SELECT 'conv:' || (query_id // 1000) AS source_id, 'conv:' || (id // 1000) AS target_id, source_id AS scope, max(score) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM nhits WHERE id <> query_id)
WHERE rank <= 3 AND score >= 1.0 AND query_id // 1000 <> id // 1000 AND query_id // 1000 <> 5 GROUP BY 1, 2, 3""", NOTES))
def g6c(spark: SparkSession, d: str) -> DataFrame:
    """Every note asks by its own content; edges from conversation 5 exist already."""
    rows = notes(spark, d)
    bridge = rows.select(F.col("id").alias("fact_id"), F.col("entity").alias("entity_id"))
    roles = F.explode(F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))).alias("scope")
    known = bridge.select(F.lit("conv:5").alias("source_id"), F.col("entity_id").alias("target_id")).distinct().select("source_id", "target_id", roles)
    return w.mined_edges(rows, bridge, known)


@query("x41_similar_hints", sql("SELECT query_id + 1000000000 AS id, id AS similar_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM nhits) WHERE rank = 1 AND score >= 1.0", NOTES))
def x41(spark: SparkSession, d: str) -> DataFrame:
    """The notes are written again under new ids; each is told what it resembles."""
    rows = notes(spark, d)
    return w.similar_hints(rows, rows.withColumn("id", F.col("id") + 1_000_000_000))


@query("l2_prepare", sql(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'claim' ELSE {x.infer_fact_type_sql('content')} END AS fact_type FROM memos WHERE id % 10 <> 0", MEMOS))
def l2(spark: SparkSession, d: str) -> DataFrame:
    """A third of the memos brings its type; every tenth holds a key and is held back."""
    rows = memos(spark, d).withColumn("fact_type", F.when(F.col("id") % 3 == 0, "claim").when(F.col("id") % 3 == 1, ""))
    rows = rows.withColumn("content", F.concat("content", F.when(F.col("id") % 10 == 0, " key sk-abcdefghijklmnop").otherwise("")))
    return w.prepare(rows, "block")[0].select("id", "fact_type")


def _store(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).withColumn("entity_ids", F.array("entity"))
    return rows.select("id", "content", "fact_type", "entity", "entity_ids", "source_id", "created_at", "superseded_at", "superseded_by")


#: Who supersedes a fact of ``ents`` (id, created_at, fact_type, source_id, e): the first new ruling after it that shares an entity.
LOST = """lost AS (SELECT o.id, min({'t': n.created_at, 'i': n.id}) AS w FROM ents o JOIN ents n ON o.e = n.e AND o.fact_type = n.fact_type AND o.source_id IS NOT DISTINCT FROM n.source_id
AND n.id % 4 = 3 AND n.id <> o.id AND (o.id % 4 <> 3 OR n.created_at > o.created_at OR (n.created_at = o.created_at AND n.id > o.id)) GROUP BY 1)"""


@query("l2_write", sql("SELECT k.id, coalesce(w.i, superseded_by) AS superseded_by FROM kept k LEFT JOIN lost USING (id)",
"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content, source_id ORDER BY id % 4 = 3, id) AS k FROM facts) WHERE k = 1),
ents AS (SELECT DISTINCT k.id, k.created_at, k.fact_type, k.source_id, f.entity AS e FROM kept k JOIN facts f ON f.content = k.content AND f.source_id IS NOT DISTINCT FROM k.source_id
WHERE k.superseded_at IS NULL AND k.fact_type = 'signup')""", LOST))
def l2w(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth fact is written to a store that holds the others."""
    rows = _store(spark, d)
    done = w.write(rows.where("id % 4 <> 3"), rows.where("id % 4 = 3"), ruling=("signup",))
    return done["facts"].select("id", "superseded_by")


@query("l2_write_untouched", sql("""SELECT id, CASE WHEN id % 3 = 0 THEN superseded_by END AS superseded_by FROM (SELECT *, row_number() OVER (PARTITION BY content, source_id ORDER BY id) AS k FROM facts) WHERE k = 1
UNION ALL SELECT 5000000000 + n_nationkey, NULL FROM nation"""))
def l2u(spark: SparkSession, d: str) -> DataFrame:
    """Rulings that clash among themselves stay as they are when notes, and rulings on other entities, are written."""
    rows = _store(spark, d)
    rows = rows.withColumns({c: F.when(F.col("id") % 3 == 0, F.col(c)) for c in ("superseded_at", "superseded_by")})
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("content", "source_id").orderBy("id"))).where("__k = 1").drop("__k")
    key, n = F.col("n_nationkey").cast("long"), v.table(spark, d, "nation")
    notes = n.select(
        (key + 5_000_000_000).alias("id"), F.concat(F.lit("a note on "), "n_name").alias("content"), F.when(key % 2 == 0, "note").otherwise("signup").alias("fact_type"),
        F.concat(F.lit("nation:"), key).alias("entity"), F.array(F.concat(F.lit("nation:"), key)).alias("entity_ids"), F.lit("ns1").alias("source_id"), F.lit(NOW).alias("created_at"),
        F.lit(None).cast("long").alias("superseded_at"), F.lit(None).cast("long").alias("superseded_by"),
    )
    return w.write(rows, notes, ruling=("signup", "purchase", "click"))["facts"].select("id", "superseded_by")


@query("l3_shared_entities", sql("SELECT f.id, coalesce(w.i, superseded_by) AS superseded_by, coalesce(w.t, superseded_at) AS superseded_at FROM facts f LEFT JOIN lost USING (id)",
"""ents AS (SELECT DISTINCT id, created_at, fact_type, source_id, unnest([entity, 'team:' || id % 60]) AS e FROM facts WHERE superseded_at IS NULL AND fact_type IN ('signup', 'purchase'))""", LOST))
def l3s(spark: SparkSession, d: str) -> DataFrame:
    """Facts on a customer and a team; every fourth is new."""
    rows = _store(spark, d).withColumn("entity_ids", F.array("entity", F.concat(F.lit("team:"), F.col("id") % 60)))
    done = life.supersede_by_new(rows, rows.where("id % 4 = 3"), ["signup", "purchase"])
    return done.select("id", "superseded_by", "superseded_at")


PATCH = """patched AS (SELECT id, CASE WHEN id % 50 = 0 THEN 'patched ' || id WHEN id % 50 = 2 THEN (SELECT content FROM facts WHERE id = 1) ELSE content END AS content,
CASE WHEN id % 50 = 1 THEN 'note' ELSE fact_type END AS fact_type, source_id, content AS before FROM facts),
judged AS (SELECT *, content <> before AND row_number() OVER (PARTITION BY content, source_id ORDER BY content <> before, id) > 1 AS lost,
CASE WHEN id > min(id) OVER g THEN min(id) OVER g ELSE nth_value(id, 2) OVER (g ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS existing_id FROM patched WINDOW g AS (PARTITION BY content, source_id))"""


def _patched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts = v.facts(spark, d).select("id", "content", "fact_type", "source_id")
    first = facts.where("id = 1").first()["content"]
    text = F.when(F.col("id") % 50 == 0, F.concat(F.lit("patched "), "id")).when(F.col("id") % 50 == 2, F.lit(first))
    changes = facts.where("id % 50 <= 2").select("id", text.alias("content"), F.when(F.col("id") % 50 == 1, "note").alias("fact_type"))
    return w.patch(facts, changes)


@query("l8_patch", sql("SELECT id, CASE WHEN lost THEN before ELSE content END AS content, fact_type FROM judged", PATCH))
def l8p(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[0].select("id", "content", "fact_type")


@query("l8_patch_errors", sql("SELECT id, existing_id FROM judged WHERE lost", PATCH))
def l8e(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[1]


@query("l8_patch_batch", sql("""SELECT id, CASE WHEN k = 3 THEN 'twin ' || id // 50 WHEN k = 4 AND first = id THEN 'twin ' || id // 50 WHEN k = 5 THEN 'one ' || id WHEN k = 6 THEN 'b ' || id ELSE content END AS content,
CASE WHEN k = 5 THEN 'note' ELSE fact_type END AS fact_type, CASE WHEN k = 3 OR (k = 4 AND first = id) THEN 'batch' ELSE source_id END AS source_id, CASE WHEN k = 4 AND first <> id THEN first END AS existing_id
FROM (SELECT *, id % 50 AS k, min(id) FILTER (id % 50 IN (3, 4)) OVER (PARTITION BY id // 50) AS first FROM facts)"""))
def l8b(spark: SparkSession, d: str) -> DataFrame:
    """In one batch: two facts that get one content, and facts with two changes each."""
    facts = v.facts(spark, d).select("id", "content", "fact_type", "source_id")
    k, words = F.col("id") % 50, lambda prefix, x: F.concat(F.lit(prefix), x)
    none = F.lit(None).cast("string")
    change = lambda rows, seq, content, kind, ns: rows.select("id", F.lit(seq).alias("seq"), content.alias("content"), kind.alias("fact_type"), ns.alias("source_id"))
    twins = change(facts.where(k.isin(3, 4)), 1, words("twin ", F.floor(F.col("id") / 50)), none, F.lit("batch"))
    first = change(facts.where(k.isin(5, 6)), 2, F.when(k == 5, words("one ", F.col("id"))).otherwise(words("a ", F.col("id"))), none, none)
    second = change(facts.where(k.isin(5, 6)), 3, F.when(k == 6, words("b ", F.col("id"))), F.when(k == 5, "note"), none)
    done, errors = w.patch(facts, twins.unionByName(first).unionByName(second))
    return done.join(errors, "id", "left")


@query("l10_pin_ids", sql("SELECT id, pinned OR fact_type = 'signup' AS pinned FROM facts"))
def l10(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d).select("id", "fact_type", "pinned")
    return w.pin(facts, facts.where("fact_type = 'signup'").select("id")).select("id", "pinned")


def _named(spark: SparkSession, d: str) -> DataFrame:
    return v.entities(spark, d).select("id", "name", "entity_type", F.array(F.lower("name")).alias("aliases"), "updated_at")


@query("l11_update_entities", sql("""SELECT id, CASE WHEN hit AND k % 4 = 0 THEN 'renamed ' || name ELSE name END AS name, CASE WHEN hit THEN lower(name) || ',desk' ELSE lower(name) END AS aliases, CASE WHEN hit THEN 9000000 ELSE updated_at END AS updated_at
FROM (SELECT *, updated_at AS k, entity_type = 'supplier' AND updated_at % 2 = 0 AS hit FROM entities)"""))
def l11u(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of odd keys are edited from a time that is not theirs."""
    rows, key = _named(spark, d), F.col("updated_at")
    name = F.when(key % 4 == 0, F.concat(F.lit("renamed "), "name"))
    edits = rows.where("entity_type = 'supplier'").select("id", (key + key % 2).alias("expected_at"), name.alias("name"), F.array(F.lit("desk")).alias("aliases"))
    done = w.update_entities(rows, edits, 9_000_000)[0]
    return done.select("id", "name", F.array_join("aliases", ",").alias("aliases"), "updated_at")


@query("l11_rename_errors", sql("""SELECT 'supplier:' || n AS id, CASE WHEN n % 3 = 0 THEN 'nation:' || n % 25 ELSE 'supplier:' || (n - 1) END AS existing_id FROM (SELECT s_suppkey AS n, row_number() OVER () FROM supplier)
WHERE n % 3 = 0 OR (n % 3 = 2 AND n - 1 IN (SELECT s_suppkey FROM supplier))"""))
def l11r(spark: SparkSession, d: str) -> DataFrame:
    """A third of the suppliers wants a nation's name, in lower case; of the others two want one new name."""
    rows, key = _named(spark, d), F.col("updated_at")
    nations = rows.where("entity_type = 'nation'").select(key.alias("nation"), F.lower("name").alias("taken"))
    asked = rows.where("entity_type = 'supplier'").join(F.broadcast(nations), key % 25 == F.col("nation"))  # 25 rows
    name = F.when(key % 3 == 0, F.col("taken")).otherwise(F.concat(F.lit("pair "), F.floor(key / 3)))
    # ids as numbers of one length, so that the earlier is the less by text too
    edits = asked.select("id", key.alias("expected_at"), name.alias("name"))
    return w.update_entities(rows, edits, 9_000_000)[1].select("id", "existing_id")


@query("l11_add_errors", sql("SELECT 'new:' || n_nationkey AS id, 'nation:' || n_nationkey AS existing_id FROM nation UNION ALL SELECT 'twin:b', NULL"))
def l11a(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d)
    taken = rows.where("entity_type = 'nation'").select(F.concat(F.lit("new:"), "updated_at").alias("id"), F.lower("name").alias("name"), "entity_type", "aliases", "updated_at")
    twins = spark.createDataFrame([("twin:a", "Twin"), ("twin:b", "twin")], "id string, name string")
    return w.add_entities(rows, taken.unionByName(twins, allowMissingColumns=True))[1]


@query("l11_delete_cascade", sql("SELECT source_id, relation_type, target_id FROM relations WHERE source_id NOT IN ('nation:3', 'supplier:2') AND target_id NOT IN ('nation:3', 'supplier:2')"))
def l11d(spark: SparkSession, d: str) -> DataFrame:
    tables = {"entities": v.entities(spark, d), "relations": v.relations(spark, d), "bridge": v.fact_entities(spark, d)}
    names = tables["entities"].where("id IN ('nation:3', 'supplier:2')").select(F.upper("name").alias("wanted"))
    return w.delete_entities(tables, names)["relations"].select("source_id", "relation_type", "target_id")


GRAM = lambda c: f"list_distinct(list_transform(range(1, length({c}) + 3), lambda i: substr('  ' || lower({c}) || '  ', i, 3)))"
NEAR = f"""asked AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name || 'x' END AS wanted FROM nation),
places AS (SELECT id, name FROM entities WHERE entity_type IN ('nation', 'region')),
near AS (SELECT wanted, id, name, round(len(list_intersect({GRAM('wanted')}, {GRAM('name')})) / len(list_distinct(list_concat({GRAM('wanted')}, {GRAM('name')})))::DOUBLE, 6) AS similarity FROM asked, places)"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = v.table(spark, d, "nation")
    wanted = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("x")))
    return v.entities(spark, d).where("entity_type IN ('nation', 'region')"), n.select(wanted.alias("wanted"))


@query("x6_get_or_fuzzy", sql("""SELECT wanted, id, name, similarity FROM (SELECT wanted, id, name, CASE WHEN lower(wanted) = lower(name) THEN 1.0 ELSE similarity END AS similarity,
row_number() OVER (PARTITION BY wanted ORDER BY lower(wanted) = lower(name) DESC, similarity DESC, id) AS n FROM near WHERE similarity >= 0.5) WHERE n = 1""", NEAR))
def x6(spark: SparkSession, d: str) -> DataFrame:
    return w.get_or_fuzzy(*_asked(spark, d))


@query("t7_suggestions", sql("SELECT wanted, pos, name FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY similarity DESC, id) AS pos FROM near WHERE similarity > 0.5) WHERE pos <= 5", NEAR))
def t7(spark: SparkSession, d: str) -> DataFrame:
    return w.suggestions(*_asked(spark, d))


REVIEW = "pending AS (SELECT item_id AS idx, CASE WHEN item_id % 10 = 0 THEN ' ' ELSE text END AS content, item_id % 3 AS k FROM benchmark)"


def _review(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = v.table(spark, d, "benchmark")
    pending = b.select(F.col("item_id").alias("idx"), F.when(F.col("item_id") % 10 == 0, " ").otherwise(F.col("text")).alias("content"))
    verdicts = pending.where("idx % 3 < 2").select("idx", F.when(F.col("idx") % 3 == 0, "commit").otherwise("discard").alias("verdict"))
    return w.review(pending, verdicts, b)


@query("l13_review_summary", sql("""SELECT count(*) FILTER (k = 0) AS attempted, count(*) FILTER (k = 0 AND trim(content) <> '') AS committed, count(*) FILTER (k = 0 AND trim(content) = '') AS failed,
count(*) FILTER (k = 1) AS discarded, count(*) FILTER (k = 2 OR (k = 0 AND trim(content) = '')) AS remaining FROM pending""", REVIEW))
def l13(spark: SparkSession, d: str) -> DataFrame:
    return _review(spark, d)[2]


@query("l13_review_kept", sql("SELECT idx FROM pending WHERE k = 2 OR (k = 0 AND trim(content) = '')", REVIEW))
def l13k(spark: SparkSession, d: str) -> DataFrame:
    return _review(spark, d)[1].select("idx")


@query("g10_session_chain", sql("SELECT 'session:' || id AS id, min(depth) AS depth FROM chain GROUP BY 1", """talks AS (SELECT DISTINCT conv_id FROM conversations),
chain(id, depth) AS (SELECT conv_id, 0 FROM talks WHERE conv_id % 5 = 4 UNION SELECT id - 1, depth + 1 FROM chain JOIN talks ON conv_id = id WHERE id % 5 <> 0 AND depth < 4)"""))
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Conversations continue the one before, in chains of five; each chain is followed back from its last."""
    talks = v.table(spark, d, "conversations").select("conv_id").distinct()
    name = lambda c: F.concat(F.lit("session:"), c)
    pairs = talks.where("conv_id % 5 <> 0").select(name(F.col("conv_id")).alias("session"), name(F.col("conv_id") - 1).alias("parent"))
    # an older edge of the same sessions gives way
    old = pairs.select("session", F.lit("session:elsewhere").alias("parent"))
    edges = w.continue_sessions(w.continue_sessions(v.relations(spark, d), old), pairs)
    return g.reach(edges, talks.where("conv_id % 5 = 4").select(name(F.col("conv_id")).alias("id")), 4, "forward", ["continued_from"])


SCOPED = """scoped AS (SELECT source_id, target_id FROM relations WHERE relation_type = 'supplied_by' AND weight::INT % 2 = 1
AND source_id IN (SELECT entity_id FROM fact_entities WHERE hash_ok(fact_id)) AND target_id IN (SELECT entity_id FROM fact_entities WHERE hash_ok(fact_id))),
hop(node, depth) AS (SELECT 'part:7', 0 UNION SELECT CASE WHEN s.source_id = node THEN s.target_id ELSE s.source_id END, depth + 1 FROM hop JOIN scoped s ON s.source_id = node OR s.target_id = node WHERE depth < 2)""".replace("hash_ok(fact_id)", "ends_with(fact_id, '.1')")


@query("g9_scoped_traversal", sql("SELECT node AS id, min(depth) AS depth FROM hop GROUP BY 1", SCOPED))
def g9(spark: SparkSession, d: str) -> DataFrame:
    """Edges of one namespace between entities that have a fact in it, here the first line of an order."""
    edges = v.relations(spark, d).where("relation_type = 'supplied_by'").withColumn("scope", F.concat(F.lit("ns"), F.col("weight").cast("int") % 2))
    visible = v.fact_entities(spark, d).where("endswith(fact_id, '.1')").select(F.col("entity_id").alias("id")).distinct()
    return g.reach(g.scoped(edges, visible, "ns1"), spark.createDataFrame([("part:7",)], "id string"), 2, "both")


@query("z10_relation_cursor", sql("SELECT source_id, target_id, weight FROM relations WHERE weight::BIGINT >= 3"))
def z10(spark: SparkSession, d: str) -> DataFrame:
    """A cursor with a time alone sends that time again; one with a key splits it in two."""
    edges = v.relations(spark, d).withColumn("created_at", F.col("weight").cast("long"))
    at = edges.where("created_at = 3").agg(F.max(interchange.edge_key()).alias("k")).first()["k"] or ""
    again, after = edges.where(interchange.edges_after(3)), edges.where(interchange.edges_after(3, at))
    return after.unionByName(again.where("created_at = 3")).select("source_id", "target_id", "weight")


@query("s15_five_passes", sql("""SELECT 'new_entities' AS part, count(*) AS n FROM nation WHERE n_nationkey > 9 UNION ALL SELECT 'new_facts', count(*) FROM facts WHERE id > 5000
UNION ALL SELECT 'changed_entities', count(*) FROM nation WHERE n_nationkey <= 9 AND n_regionkey >= 2 UNION ALL SELECT 'changed_facts', count(*) FROM facts WHERE id <= 5000 AND (created_at, id) > (1705000000000, 10)
UNION ALL SELECT 'edges', count(*) FROM relations WHERE weight::BIGINT >= 2"""))
def s15p(spark: SparkSession, d: str) -> DataFrame:
    nations = v.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("updated_at"))
    facts = v.facts(spark, d).select("id", F.col("created_at").alias("updated_at"))
    edges = v.relations(spark, d).withColumn("created_at", F.col("weight").cast("long"))
    cursor = {"entity": 9, "fact": 5000, "entity_updated": (2, -1), "fact_updated": (1_705_000_000_000, 10), "edge": (2, None)}
    found = interchange.passes(nations, facts, edges, cursor)
    out = None
    for name, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("s16_envelope_import", sql("""SELECT id, CASE WHEN id % 5 = 0 THEN 'sent ' || id ELSE content END AS content, CASE WHEN id % 5 = 0 THEN created_at + 1 ELSE created_at END AS updated_at FROM facts
UNION ALL SELECT 900000001, 'new over there', 5"""))
def s16(spark: SparkSession, d: str) -> DataFrame:
    """An envelope with later, earlier and new facts over a store."""
    local = v.facts(spark, d).select("id", "content", "source_id", F.col("created_at").alias("updated_at"))
    sent = local.where("id % 5 <= 1").withColumn("content", F.concat(F.lit("sent "), "id"))
    sent = sent.withColumn("updated_at", F.col("updated_at") + F.when(F.col("id") % 5 == 0, 1).otherwise(-1))
    fresh = spark.createDataFrame([(900_000_001, "new over there", "ns1", 5)], local.schema)
    lines = interchange.envelope({"fact": sent.unionByName(fresh)}, NOW)
    return interchange.apply_envelope(lines, {"fact": local})["fact"].select("id", "content", "updated_at")


for _op, _select in {
    "count": "SELECT count(*) AS n FROM memos",
    "by_entity": "SELECT priority AS entity, count(*) AS n, 'note' AS types, max(price) AS best FROM memos GROUP BY 1",
    "sum_currency": "SELECT 'USD' AS unit, sum(round(price * 100)) AS total, count(*) AS mentions FROM memos",
    "count_distinct_dates": "SELECT count(DISTINCT d) AS n FROM (SELECT day AS d FROM memos UNION ALL SELECT (day - INTERVAL 1 DAY)::DATE FROM memos WHERE priority = '1-URGENT')",
    "enumerate": "SELECT id, 'note' AS fact_type, left(content, 80) || CASE WHEN length(content) > 80 THEN '…' ELSE '' END AS preview FROM memos ORDER BY id LIMIT 20",
}.items():

    @query(f"aggregate_{_op}", sql(_select, MEMOS))
    def _aggregate(spark: SparkSession, d: str, op: str = _op) -> DataFrame:
        o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("entity"), F.col("o_totalprice").cast("double").alias("source_confidence"))
        return a.aggregate(memos(spark, d).join(o, "id").withColumn("fact_type", F.lit("note")), op)


@query("r28_with_archive", sql("""SELECT id, tier, rank FROM (SELECT *, row_number() OVER (ORDER BY source_confidence DESC, tier, id) AS rank FROM (
SELECT * FROM (SELECT id, 0 AS tier, source_confidence FROM facts WHERE superseded_at IS NULL ORDER BY source_confidence DESC, id LIMIT 30)
UNION ALL SELECT * FROM (SELECT id, 1, source_confidence FROM facts WHERE superseded_at IS NOT NULL ORDER BY source_confidence DESC, id LIMIT 30))) WHERE rank <= 30"""))
def r28(spark: SparkSession, d: str) -> DataFrame:
    """The best of the hot and of the cold tier, ranked together; a fact in both counts as hot."""
    facts = v.facts(spark, d).select("id", "superseded_at", F.col("source_confidence").alias("score"))
    best = lambda df: f.page(df, [F.desc("score"), F.col("id")], 30).select("id", "score")
    hot, cold = facts.where("superseded_at IS NULL"), facts.where("superseded_at IS NOT NULL OR id % 7 = 0")
    cold_hits = best(cold.join(hot.select("id"), "id", "left_anti"))
    return r.with_archive(best(hot), cold_hits, 30).select("id", "tier", "rank")


@query("x43_workflow_messages", sql("""SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS is_trigger, 'Order ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' in ticket' ELSE ' in print' END AS title,
CASE o_orderkey % 3 WHEN 0 THEN 'team/' || (o_orderkey % 7) WHEN 1 THEN 'desk ' || (o_orderkey % 5) END AS namespace FROM orders"""))
def x43(spark: SparkSession, d: str) -> DataFrame:
    """Messages of orders: every second names a ticket, two of three a namespace, in either form."""
    k = F.col("o_orderkey")
    named = F.when(k % 3 == 0, F.concat(F.lit("source_id: team/"), k % 7)).when(k % 3 == 1, F.concat(F.lit('Source ID is "desk '), k % 5, F.lit('"'))).otherwise("no namespace")
    first = F.concat(F.lit("Order "), k, F.when(k % 2 == 0, " in ticket").otherwise(" in print"))
    rows = v.table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("\n  "), first, F.lit("  \n"), named).alias("message"))
    return rows.select("id", x.workflow_of(F.col("message")).alias("w")).select("id", "w.*")


@query("t10_shrink_ladder", sql("""SELECT part, id, length(content) AS size FROM (SELECT 'hits' AS part, pos, id, CASE WHEN length(content) > 80 THEN left(content, 80) || '…' ELSE content END AS content FROM (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM texts WHERE length(content) > 250) WHERE pos <= 10
UNION ALL SELECT 'recent', pos, id, left(content, 80) || '…' FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS pos FROM texts WHERE length(content) > 250) WHERE pos <= 10)"""))
def t10(spark: SparkSession, d: str) -> DataFrame:
    """Ten hits and ten recent texts fit 1,700 characters once previews are at 80 and one mark."""
    rows = v.texts(spark, d).where("length(content) > 250").select("id", "content")
    parts = {"hits": r.top(rows, [F.col("id")], 10, "pos"), "recent": r.top(rows, [F.desc("id")], 10, "pos"), "related": v.relations(spark, d).select(F.col("source_id").alias("id")).limit(5)}
    found = f.shrunk(parts, 1700)
    pick = lambda name: found[name].select(F.lit(name).alias("part"), "id", F.length("content").cast("long").alias("size"))
    return pick("hits").unionByName(pick("recent"))


# ---- service rows ------------------------------------------------------------------


@query("v6_replays", sql("SELECT id AS command_id, CASE WHEN id % 2 = 0 THEN 'new' WHEN id % 3 = 0 THEN 'conflict' ELSE 'replay' END AS outcome FROM facts"))
def v6(spark: SparkSession, d: str) -> DataFrame:
    log = v.facts(spark, d).select(F.col("id").alias("command_id"), F.col("fact_type").alias("actor"), F.sha2("content", 256).alias("fingerprint"), F.col("entity").alias("resource"))
    again = log.withColumn("actor", F.when(F.col("command_id") % 3 == 0, "someone else").otherwise(F.col("actor")))
    return s.replays(log.where("command_id % 2 = 1"), again)


EXPIRES = "reserved AS (SELECT id, created_at + 86400000 AS expires_at FROM facts)"


@query("v20_reaped", sql("SELECT 'g' || id AS generation, expires_at + 1000 AS collect_at FROM reserved WHERE expires_at <= 1706000000000 ORDER BY expires_at, id LIMIT 500", EXPIRES))
def v20(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).select("id", F.concat(F.lit("g"), "id").alias("generation"), (F.col("created_at") + 86_400_000).alias("expires_at"))
    return s.reaped(rows, 1_706_000_000_000, 500, 1000)[1]


@query("v22_pruned", sql("""SELECT 'a' AS part, id FROM reserved WHERE id % 10 = 0 AND expires_at > 1705000000000 UNION ALL
SELECT 'b', id FROM (SELECT *, row_number() OVER (ORDER BY expires_at > 1705000000000, expires_at, id) AS n FROM reserved WHERE id % 10 <> 0)
WHERE n > 1000 - (SELECT count(*) FROM reserved WHERE id % 10 = 0 AND expires_at <= 1705000000000) OR expires_at > 1705000000000""", EXPIRES))
def v22(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).select("id", (F.col("created_at") + 86_400_000).alias("retain_until"))
    first, second = s.pruned(rows.where("id % 10 = 0"), rows.where("id % 10 <> 0"), 1_705_000_000_000, 1000)
    return first.select(F.lit("a").alias("part"), "id").unionByName(second.select(F.lit("b").alias("part"), "id"))


@query("v23_returns", sql("""SELECT id, id % 2 = 0 AND id % 3 <> 0 AS accepted, CASE WHEN id % 2 = 0 AND id % 3 <> 0 AND id % 5 <> 0 THEN 'completed' ELSE CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'accepted' END END AS status FROM facts"""))
def v23(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).select("id", "source_id", F.col("entity").alias("session"), F.col("fact_type").alias("actor"))
    handoffs = rows.select(
        "id", "source_id", "session", F.col("actor").alias("receiver"), F.lit("c1").alias("claim_id"), F.when(F.col("id") % 3 == 0, "pending").otherwise("accepted").alias("status"),
        F.lit(None).cast("long").alias("result_fact_id"), F.lit(None).cast("string").alias("outcome"),
    )
    returns = rows.select("id", F.col("id").alias("fact_id"), "actor", F.when(F.col("id") % 2 == 0, "c1").otherwise("c2").alias("claim_id"), F.when(F.col("id") % 5 == 0, "failed").otherwise("succeeded").alias("outcome"))
    return s.returned(handoffs, rows, returns)


@query("v25_lanes", sql("""SELECT id, CASE fact_type WHEN 'view' THEN CASE WHEN old THEN 'attention' ELSE 'ready' END WHEN 'click' THEN CASE WHEN old THEN 'attention' ELSE 'in_progress' END WHEN 'error' THEN 'attention' ELSE 'returned' END AS lane,
CASE fact_type WHEN 'view' THEN CASE WHEN old THEN 'inspect_or_run' ELSE 'accept_or_run' END WHEN 'click' THEN CASE WHEN old THEN 'check_worker_liveness' ELSE 'wait_for_result' END WHEN 'error' THEN 'orchestrator_retry_or_close' ELSE 'validate_result' END AS next_action,
old AND fact_type IN ('view', 'click', 'error') AS stale FROM (SELECT *, 1706000000000 - coalesce(observed_at, created_at) >= 864000000 AS old FROM facts)"""))
def v25(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("fact_type")
    rows = v.facts(spark, d).select(
        "id", "created_at", F.col("observed_at").alias("accepted_at"), F.lit(None).cast("long").alias("heartbeat_at"), F.lit(None).cast("long").alias("returned_at"),
        F.when(kind == "view", "pending").when(kind.isin("click", "error"), "accepted").otherwise("completed").alias("status"), F.when(kind == "error", "failed").alias("outcome"),
    )
    return s.lanes(rows, 1_706_000_000_000, 864_000_000)


@query("v26_reconciled", sql("""SELECT 'hot' AS part, id::VARCHAR AS id FROM facts WHERE id % 4 <> 0 UNION ALL SELECT 'entities', id FROM entities WHERE entity_type = 'customer' AND
(updated_at % 2 = 0 OR id IN (SELECT entity FROM facts WHERE id % 4 = 0)) AND NOT (updated_at % 2 = 1 AND updated_at % 5 = 0) UNION ALL
SELECT DISTINCT 'unresolved', entity FROM facts WHERE id % 4 = 0 AND split_part(entity, ':', 2)::BIGINT % 2 = 1 AND
(split_part(entity, ':', 2)::BIGINT % 5 = 0 OR entity NOT IN (SELECT id FROM entities))
UNION SELECT 'unresolved', entity FROM facts WHERE id % 4 = 0 AND entity NOT IN (SELECT id FROM entities)"""))
def v26(spark: SparkSession, d: str) -> DataFrame:
    """Cold facts still in the hot table, and entities of which only a later snapshot knows some."""
    facts, people = v.facts(spark, d).select("id", "entity"), v.entities(spark, d).where("entity_type = 'customer'").select("id", "updated_at")
    found = s.reconciled(facts, facts.where("id % 4 = 0"), people.where("updated_at % 2 = 0"), people.where("updated_at % 5 <> 0"))
    return found["hot"].select(F.lit("hot").alias("part"), F.col("id").cast("string").alias("id")).unionByName(
        found["entities"].select(F.lit("entities").alias("part"), "id")
    ).unionByName(found["unresolved"].select(F.lit("unresolved").alias("part"), "id"))


@query("v27_segment_faults", sql("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'size' ELSE 'digest' END AS fault FROM documents WHERE doc_id % 10 = 0 OR doc_id % 15 = 1"))
def v27(spark: SparkSession, d: str) -> DataFrame:
    t = v.texts(spark, d).where("content IS NOT NULL")
    size = F.octet_length("content") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)
    digest = F.when(F.col("id") % 15 == 1, "0").otherwise(F.sha2("content", 256))
    return s.segment_faults(t.select("id", F.col("content").alias("payload"), size.alias("bytes"), digest.alias("sha256")))


@query("z13_stale_lease_rows", sql("SELECT id FROM reserved WHERE expires_at <= 1706000000000", EXPIRES))
def z13(spark: SparkSession, d: str) -> DataFrame:
    rows = v.facts(spark, d).select("id", (F.col("created_at") + 86_400_000).alias("expires_at"))
    return s.stale_leases(rows, 1_706_000_000_000).select("id")
