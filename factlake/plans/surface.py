"""Queries of the store's calls: topics, contexts, envelopes, rendered texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import api
from factlake import views as v
from factlake.plans.registry import query
from factlake.views import sql

NOW = 1_710_000_000_000


def memory(spark: SparkSession, d: str) -> api.Memory:
    return api.Memory(v.facts(spark, d), v.entities(spark, d), v.fact_entities(spark, d), v.relations(spark, d))


def parts(found: dict[str, DataFrame], key: dict[str, str]) -> DataFrame:
    """(part, id) rows of several results."""
    out = None
    for name, df in found.items():
        if name in key:
            rows = df.select(F.lit(name).alias("part"), F.col(key[name]).cast("string").alias("id"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("r29_topic_query", sql("""SELECT 'entity' AS part, id FROM entities WHERE lower(name) = 'customer#000000007'
UNION ALL SELECT 'around', 'customer:7' UNION ALL SELECT 'around', target_id FROM relations WHERE source_id = 'customer:7'
UNION ALL SELECT 'recent', id::VARCHAR FROM (SELECT id FROM facts WHERE entity = 'customer:7' ORDER BY created_at DESC, id DESC LIMIT 10)"""))
def r29(spark: SparkSession, d: str) -> DataFrame:
    found = memory(spark, d).query("Customer#000000007", "local")
    return parts(found, {"entity": "id", "around": "id", "recent": "id"})


@query("r31_context", sql(f"""SELECT 'pinned' AS part, id::VARCHAR AS id FROM (SELECT id FROM facts WHERE pinned ORDER BY created_at DESC, id LIMIT 20)
UNION ALL SELECT 'personal', id::VARCHAR FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM facts WHERE fact_type = 'error' AND superseded_at IS NULL) WHERE n <= 5
UNION ALL SELECT 'recent', id::VARCHAR FROM (SELECT id FROM facts WHERE coalesce(observed_at, created_at) >= {NOW - 7 * 86_400_000} ORDER BY id LIMIT 50)"""))
def r31(spark: SparkSession, d: str) -> DataFrame:
    return parts(memory(spark, d).context("69", NOW), {"pinned": "id", "personal": "id", "recent": "id"})


@query("r32_session_start", sql("""SELECT 'pinned' AS part, id::VARCHAR AS id FROM (SELECT id FROM facts WHERE pinned ORDER BY created_at DESC, id LIMIT 20)
UNION ALL SELECT 'top_entities', id FROM (SELECT e.id, count(b.fact_id) AS n FROM entities e LEFT JOIN fact_entities b ON b.entity_id = e.id GROUP BY 1 ORDER BY n DESC, e.id LIMIT 10)"""))
def r32(spark: SparkSession, d: str) -> DataFrame:
    return parts(memory(spark, d).session_start(NOW, ["signup"]), {"pinned": "id", "top_entities": "id"})


@query("r30_workflow_start", sql("SELECT 'session' AS part, 'session:T-1' AS id UNION ALL SELECT 'fact', 'session:T-1'"))
def r30(spark: SparkSession, d: str) -> DataFrame:
    return parts(memory(spark, d).workflow_start("T-1", "checkout fails with k 69", NOW), {"session": "id", "fact": "entity"})


@query("x39_session_canvas", sql("""SELECT 'graph TD' || chr(10) || '  s[c7]' || chr(10) || string_agg('  s --> f' || id || '["' || fact_type || '"]', chr(10) ORDER BY created_at, id) || chr(10) || chr(10) ||
string_agg('- ' || fact_type || ': ' || content, chr(10) ORDER BY created_at, id) AS text FROM (SELECT * FROM facts WHERE entity = 'customer:7' ORDER BY created_at, id LIMIT 20)"""))
def x39(spark: SparkSession, d: str) -> DataFrame:
    few = v.facts(spark, d).where("entity = 'customer:7'").orderBy("created_at", "id").limit(20)
    return api.canvas("c7", few)


@query("x40_handoff_packet", sql("""SELECT 'To: b' || chr(10) || 'Focus: x' || chr(10) || 'Done when: y' || chr(10) || '## Lessons' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY created_at, id) FILTER (fact_type = 'error') || chr(10) ||
'## Notes' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY created_at, id) FILTER (fact_type <> 'error') AS text FROM (SELECT * FROM facts WHERE entity = 'customer:7' AND superseded_at IS NULL)"""))
def x40(spark: SparkSession, d: str) -> DataFrame:
    now = v.facts(spark, d).where("entity = 'customer:7' AND superseded_at IS NULL")
    return api.handoff_packet("b", "x", "y", now)
