"""Queries over the graph of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import views as v
from factlake.operators import aggregates as a
from factlake.operators import graph as g
from factlake.operators import ranking as r
from factlake.operators import scc
from factlake.plans.registry import query
from factlake.views import sql

START = "part:7"
WALK = f"""walk(node, depth) AS (SELECT '{START}', 0 UNION SELECT r.target_id, depth + 1 FROM walk JOIN relations r ON r.source_id = node WHERE depth < 4),
near AS (SELECT node AS id, min(depth) AS depth FROM walk GROUP BY 1)"""


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(START,)], "id string")


@query("g1_traverse", sql("SELECT id, depth FROM near WHERE depth <= 3", WALK))
def g1(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(v.relations(spark, d), _start(spark), 3)[0]


@query("g1_traverse_edges", sql("SELECT source_id, relation_type, target_id FROM relations WHERE source_id IN (SELECT id FROM near WHERE depth <= 3)", WALK))
def g1e(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(v.relations(spark, d), _start(spark), 3)[1].select("source_id", "relation_type", "target_id")


@query("g1_visited", sql("SELECT count(*) AS visited_count FROM near WHERE depth <= 4", WALK))
def g1v(spark: SparkSession, d: str) -> DataFrame:
    return g.traverse(v.relations(spark, d), _start(spark), 3)[2].agg(F.count("*").alias("visited_count"))


@query("g1_traverse_both", sql("""SELECT node AS id, min(depth) AS depth FROM walk2 GROUP BY 1""", """walk2(node, depth) AS (SELECT 'region:1', 0 UNION
SELECT CASE WHEN r.source_id = node THEN r.target_id ELSE r.source_id END, depth + 1 FROM walk2 JOIN relations r ON (r.source_id = node OR r.target_id = node) AND r.relation_type IN ('part_of', 'located_in') WHERE depth < 2)"""))
def g1b(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("region:1",)], "id string")
    return g.traverse(v.relations(spark, d), start, 2, "both", ["part_of", "located_in"])[0]


PATH = f"""paths(node, depth, path) AS (SELECT '{START}', 0, ''::VARCHAR UNION ALL SELECT r.target_id, depth + 1, path || node || '>' || r.relation_type || '>' || r.target_id || ';'
FROM paths JOIN relations r ON r.source_id = node WHERE depth < 4 AND NOT contains(';' || path, '>' || r.target_id || ';'))"""


@query("g2_shortest_path", sql("SELECT length(path) - length(replace(path, ';', '')) AS hops, path FROM (SELECT depth, min(path) AS path FROM paths WHERE node = 'region:1' GROUP BY 1 ORDER BY depth LIMIT 1)", PATH))
def g2(spark: SparkSession, d: str) -> DataFrame:
    path = g.shortest_path(v.relations(spark, d), START, "region:1")
    line = F.array_join(F.transform("path", lambda s: F.concat(s["source_id"], F.lit(">"), s["relation_type"], F.lit(">"), s["target_id"], F.lit(";"))), "")
    return path.select(F.size("path").cast("long").alias("hops"), line.alias("path"))


@query("g3_simple_paths", sql("SELECT path FROM walks WHERE starts_with(node, 'region:')", f"""walks(node, depth, path) AS (SELECT '{START}', 0, '{START}' UNION ALL
SELECT t, depth + 1, path || '/' || t FROM walks JOIN (SELECT DISTINCT source_id AS s, target_id AS t FROM relations) ON s = node WHERE depth < 4 AND NOT contains('/' || path || '/', '/' || t || '/'))"""))
def g3(spark: SparkSession, d: str) -> DataFrame:
    found = g.simple_paths(v.relations(spark, d), _start(spark), F.col("id").startswith("region:"), 4)
    return found.select(F.array_join("path", "/").alias("path"))


@query("g4_cycles", sql("SELECT path AS cycle FROM loops WHERE closed", """loops(first, node, depth, path, closed) AS (SELECT DISTINCT source_id, target_id, 1, source_id || '/' || target_id, false FROM relations WHERE source_id < target_id
UNION ALL SELECT first, t, depth + 1, CASE WHEN t = first THEN path ELSE path || '/' || t END, t = first FROM loops JOIN (SELECT DISTINCT source_id AS s, target_id AS t FROM relations) ON s = node
WHERE NOT closed AND t >= first AND (t = first OR NOT contains('/' || path || '/', '/' || t || '/')))"""))
def g4(spark: SparkSession, d: str) -> DataFrame:
    return g.cycles(v.relations(spark, d)).select(F.array_join("cycle", "/").alias("cycle"))


#: Each part leads to the one whose key is its square and one, around the number of parts: trees that end in cycles.
LEADS = """leads AS (SELECT source_id AS a, target_id AS b FROM relations WHERE relation_type = 'sells_to' UNION
SELECT 'part:' || p_partkey, 'part:' || (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) FROM part),
ways(a, b) AS (SELECT a, b FROM leads UNION SELECT w.a, l.b FROM ways w JOIN leads l ON l.a = w.b),
strong AS (SELECT x.a AS id, min(x.b) AS component, count(*) AS size FROM ways x JOIN ways y ON x.a = y.b AND x.b = y.a GROUP BY 1)"""


def _leads(spark: SparkSession, d: str) -> DataFrame:
    """Trade and supply, and what parts lead to."""
    key, parts = F.col("p_partkey").cast("long"), v.table(spark, d, "part")
    after = parts.select(
        F.concat(F.lit("part:"), key).alias("source_id"), F.lit("leads_to").alias("relation_type"), F.concat(F.lit("part:"), (key * key + 1) % F.lit(parts.count())).alias("target_id"),
    )
    return v.relations(spark, d).select("source_id", "relation_type", "target_id").unionByName(after)


@query("g4_strong_components", sql("SELECT id, component, size FROM strong", LEADS))
def g4s(spark: SparkSession, d: str) -> DataFrame:
    return scc.strong_components(_leads(spark, d))


@query("g4_condensed", sql("""SELECT DISTINCT coalesce(x.component, a) AS a, coalesce(y.component, b) AS b FROM leads LEFT JOIN strong x ON x.id = a LEFT JOIN strong y ON y.id = b
WHERE coalesce(x.component, a) <> coalesce(y.component, b)""", LEADS))
def g4c(spark: SparkSession, d: str) -> DataFrame:
    """What is left without cycles once each component is one node."""
    return scc.condensed(_leads(spark, d), ["sells_to", "leads_to"])


@query("g5_upsert_edges", sql("""SELECT source_id, relation_type, target_id, CASE WHEN relation_type = 'part_of' THEN 2.0 ELSE weight END AS weight FROM relations"""))
def g5(spark: SparkSession, d: str) -> DataFrame:
    old = v.relations(spark, d)
    new = old.where("relation_type = 'part_of'").withColumn("weight", F.lit(2.0))
    return g.upsert_edges(old, new).drop("scope")


@query("g5_remove_edges", sql("SELECT source_id, relation_type, target_id FROM relations WHERE relation_type <> 'sells_to'"))
def g5r(spark: SparkSession, d: str) -> DataFrame:
    old = v.relations(spark, d)
    return g.without_edges(old, old.where("relation_type = 'sells_to'")).select("source_id", "relation_type", "target_id")


@query("g6_mined_edges", sql("""SELECT source_id, target_id, n, pos FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, target_id) AS pos FROM (
SELECT a.entity_id AS source_id, b.entity_id AS target_id, count(*) AS n FROM fact_entities a JOIN fact_entities b USING (fact_id) WHERE a.entity_id < b.entity_id GROUP BY 1, 2) c
WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.source_id = c.source_id AND r.target_id = c.target_id AND r.weight > 1)) WHERE pos <= 3"""))
def g6(spark: SparkSession, d: str) -> DataFrame:
    """Entities named together, less the strong edges that exist, the best three of each."""
    new = a.without_existing(a.co_mentions(v.fact_entities(spark, d)), v.relations(spark, d).where("weight > 1"), ["source_id", "target_id"])
    return a.top_per(new, ["source_id"], [F.desc("n"), F.col("target_id")], 3)


@query("g7_graph_text", sql("SELECT 'graph LR' || chr(10) || string_agg('  ' || source_id || ' -- ' || relation_type || ' --> ' || target_id, chr(10) ORDER BY '  ' || source_id || ' -- ' || relation_type || ' --> ' || target_id) AS text FROM relations WHERE relation_type = 'part_of'"))
def g7(spark: SparkSession, d: str) -> DataFrame:
    return g.mermaid(v.relations(spark, d).where("relation_type = 'part_of'"))


@query("g8_components", sql("SELECT node, min(other) AS component FROM flood GROUP BY 1", """flood(node, other) AS (SELECT source_id, source_id FROM relations WHERE relation_type = 'sells_to' UNION SELECT target_id, target_id FROM relations WHERE relation_type = 'sells_to'
UNION SELECT CASE WHEN r.source_id = node THEN r.target_id ELSE r.source_id END, other FROM flood JOIN relations r ON r.relation_type = 'sells_to' AND (r.source_id = node OR r.target_id = node))"""))
def g8(spark: SparkSession, d: str) -> DataFrame:
    e = v.relations(spark, d).where("relation_type = 'sells_to'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    found = g.components(e)
    heads = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(heads).distinct()


@query("r14_graph_expansion", sql("""SELECT DISTINCT b.fact_id FROM fact_entities b WHERE b.entity_id IN (SELECT CASE WHEN r.source_id = 'supplier:4' THEN r.target_id ELSE r.source_id END
FROM relations r WHERE r.source_id = 'supplier:4' OR r.target_id = 'supplier:4') AND b.entity_id <> 'supplier:4'"""))
def r14(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the neighbours of a seed, in both directions, without the seed's own."""
    seed = spark.createDataFrame([("supplier:4",)], "id string")
    near = g.reach(v.relations(spark, d), seed, 1, "both").where("depth = 1").select(F.col("id").alias("entity_id"))
    return v.fact_entities(spark, d).join(near, "entity_id", "left_semi").select("fact_id").distinct()


@query("r27_search_in_scope", sql("SELECT f.id, f.entity FROM facts f WHERE f.fact_type = 'purchase' AND f.entity IN (SELECT source_id FROM relations WHERE relation_type = 'located_in' AND target_id IN (SELECT source_id FROM relations WHERE target_id = 'region:2'))"))
def r27(spark: SparkSession, d: str) -> DataFrame:
    """Facts on entities that reach a region, by the edges back from it."""
    start = spark.createDataFrame([("region:2",)], "id string")
    inside = g.reach(v.relations(spark, d), start, 2, "reverse", ["part_of", "located_in"]).where("depth = 2")
    return v.facts(spark, d).where("fact_type = 'purchase'").join(inside.select(F.col("id").alias("entity")), "entity", "left_semi").select("id", "entity")


@query("r19_centrality", sql("SELECT entity_id, round(1 + 0.1 * log10(1 + n), 6) AS prior FROM (SELECT entity_id, count(*) AS n FROM fact_entities GROUP BY 1)"))
def r19(spark: SparkSession, d: str) -> DataFrame:
    n = v.fact_entities(spark, d).groupBy("entity_id").agg(F.count("*").alias("n"))
    return n.select("entity_id", F.round(r.centrality_prior(F.col("n"), 0.1), 6).alias("prior"))
