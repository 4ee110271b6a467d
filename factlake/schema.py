"""Columns of the logical tables, and normalisers of their open enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTS = """id string, content string, fact_type string, entity_ids array<string>, tags array<string>, source string,
source_id string, actor_id string, source_confidence double, relevance_score double, created_at long, updated_at long,
last_accessed_at long, observed_at long, superseded_at long, superseded_by string, access_count int, pinned boolean"""
ENTITIES = """id string, name string, entity_type string, aliases array<string>, tags array<string>, source_page string,
created_at long, updated_at long, summary string"""
RELATIONS = """source_id string, relation_type string, target_id string, scope string, weight double,
evidence array<string>, created_at long"""
CHANGES = """project string, epoch long, seq long, kind string, id string, operation string, revision long,
actor_id string, committed_at long, body string"""

#: Spellings of fact types that stand for another.
FACT_TYPES = ("decision", "convention", "preference", "lesson", "error", "pattern", "claim", "note", "question", "unknown")
TYPE_ALIASES = {f"{t}s": t for t in FACT_TYPES[:-1]} | {"antipattern": "pattern", "anti-pattern": "pattern"}
ENTITY_ALIASES = {"tech": "technology", "compare": "comparison", "question": "query"}


def fact_type(raw: Column) -> Column:
    """One of FACT_TYPES; anything unrecognised is ``unknown``."""
    low = F.lower(F.trim(raw))
    out = F.when(low.isin(*FACT_TYPES), low)
    for alias, name in TYPE_ALIASES.items():
        out = out.when(low == alias, name)
    return out.otherwise("unknown")


def entity_type(raw: Column) -> Column:
    """Lower case, with known aliases resolved; blank is ``unknown``."""
    low = F.lower(F.trim(raw))
    out = F.when(F.coalesce(low, F.lit("")) == "", "unknown")
    for alias, name in ENTITY_ALIASES.items():
        out = out.when(low == alias, name)
    return out.otherwise(low)


def namespace(raw: Column) -> Column:
    """Trimmed; blank is null."""
    return F.when(F.trim(raw) != "", F.trim(raw))


def visible_time(observed: Column | None = None, created: Column | None = None) -> Column:
    """When a fact happened: observed, else created."""
    return F.coalesce(F.col("observed_at") if observed is None else observed, F.col("created_at") if created is None else created)
