"""Joins, groupings and windows over facts, entities and their bridge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.functions.text import slots
from factlake.operators.filters import shortened
from factlake.staging import ranked, small

DAY_S = 86_400


def entity_counts(entities: DataFrame, bridge: DataFrame) -> DataFrame:
    """Entities with ``fact_count``, 0 for those without facts."""
    counts = bridge.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("fact_count"))
    return entities.join(counts, "id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0)))


def facts_of(bridge: DataFrame, entity_ids: list[str]) -> DataFrame:
    return bridge.where(F.col("entity_id").isin(entity_ids)).select("fact_id").distinct()


def entity_names(bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """Names of each fact's entities in the fact's own order (``pos`` of the bridge, else
    by id); missing ones are skipped."""
    place = [c for c in ("pos", "entity_id") if c in bridge.columns]
    named = bridge.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    ordered = F.sort_array(F.collect_list(F.struct(*place, "name")))
    return named.groupBy("fact_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), "; ").alias("names"))


def by_tag_joins(entities: DataFrame, tags: list[str]) -> DataFrame:
    """Ids that have every tag: one semi-join per tag on the exploded tags."""
    index = entities.select("id", F.explode("tags").alias("tag"))
    out = entities.select("id")
    for t in tags:
        out = out.join(index.where(F.col("tag") == t), "id", "left_semi")
    return out


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their place as ``pos``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= n)


def renumbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Ranks from 1 over rows that a ranking has already limited."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def without_existing(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys), keys, "left_anti")


def co_mentions(bridge: DataFrame) -> DataFrame:
    """Pairs of entities that share facts; a fact has few entities."""
    per = bridge.groupBy("fact_id").agg(F.sort_array(F.collect_set("entity_id")).alias("e")).where(F.size("e") > 1)
    one = per.select("e", F.posexplode("e").alias("i", "source_id"))
    two = one.select("source_id", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("target_id"))
    return two.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def stats(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts; three one-row aggregates are put side by side."""
    parts = [
        facts.agg(F.count("*").alias("facts"), F.max("created_at").alias("last_ingest")),
        entities.agg(F.count("*").alias("entities")),
        relations.agg(F.count("*").alias("relations")),
    ]
    keyed = [p.withColumn("__one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "__one"), keyed).select("facts", "entities", "relations", "last_ingest")


def type_buckets(entities: DataFrame, n: int) -> DataFrame:
    """Entities per type and the first ``n`` names of each, without collecting the rest."""
    counts = entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    few = top_per(entities, ["entity_type"], [F.col("name"), F.col("id")], n)
    names = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return counts.join(few.groupBy("entity_type").agg(F.array_join(names, "; ").alias("examples")), "entity_type")


def fact_buckets(facts: DataFrame, since: int) -> DataFrame:
    return facts.groupBy("fact_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("superseded_at").isNull()).alias("n_current"),
        F.count_if("pinned").alias("n_pinned"), F.count_if(F.col("created_at") >= since).alias("n_recent"),
    )


def by_entity(hits: DataFrame, entity: str, score: str) -> DataFrame:
    """Hits per entity: count, sorted distinct types, best score."""
    key = F.coalesce(F.col(entity), F.lit("(no entity)")).alias("entity")
    return hits.groupBy(key).agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("fact_type")), ",").alias("types"),
        F.max(score).alias("best"),
    )


def pending_stats(candidates: DataFrame) -> DataFrame:
    c = F.col("source_confidence")
    bands = [(None, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, None)]
    inside = lambda lo, hi: (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c < hi)
    return candidates.groupBy("fact_type").agg(
        F.count("*").alias("n"), F.min(c).alias("low"), F.round(F.avg(c), 9).alias("mean"), F.max(c).alias("high"),
        *[F.count_if(inside(lo, hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(bands)],
    )


def coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key tuple, with the total and the rows that lack a key."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in keys])
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    both = df.agg(F.count("*").alias("total"), F.count_if(blank).alias("blank"))
    return groups.withColumn("__one", F.lit(1)).join(F.broadcast(both.withColumn("__one", F.lit(1))), "__one").drop("__one")


def multi_membership(rows: DataFrame, names: str = "names") -> GroupedData:
    """Grouping in which a row belongs to each of its entities."""
    return rows.withColumn("entity_id", F.explode_outer(names)).groupBy("entity_id")


def session_blocks(turns: DataFrame, hits: DataFrame) -> DataFrame:
    """Whole sessions, in order, of every session that has a hit."""
    rows = turns.join(hits, "conv_id", "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(ordered, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(lines, "\n").alias("block"))


def ordered_fingerprint(relations: DataFrame, chunk: int = 1000) -> DataFrame:
    """SHA-256 per type over its ordered edges, in two levels: over the digests of
    every ``chunk`` edges in order, so that no row holds all edges of a type."""
    rows = ranked(relations, [F.col("relation_type"), F.col("source_id"), F.col("target_id")], "__rank")
    first = rows.groupBy("relation_type").agg(F.min("__rank").alias("__first"))  # a row per type
    rows = rows.join(small(first), "relation_type").withColumn("__chunk", F.floor((F.col("__rank") - F.col("__first")) / chunk))
    edges = F.sort_array(F.collect_list(F.struct("source_id", "target_id")))
    lines = F.transform(edges, lambda x: F.concat(x["source_id"], F.lit(">"), x["target_id"]))
    parts = rows.groupBy("relation_type", "__chunk").agg(F.sha2(F.array_join(lines, ","), 256).alias("digest"))
    digests = F.transform(F.sort_array(F.collect_list(F.struct("__chunk", "digest"))), lambda x: x["digest"])
    return parts.groupBy("relation_type").agg(F.sha2(F.array_join(digests, ","), 256).alias("fingerprint"))


def set_fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """A fingerprint that does not depend on order, for any number of rows."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys).cast("decimal(20,0)")).alias("fingerprint"))


def record_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose rows are new, gone or changed."""
    digest = lambda df: F.xxhash64(*[c for c in df.columns if c != key])
    a = old.select(F.col(key).alias("ka"), digest(old).alias("ha"))
    b = new.select(F.col(key).alias("kb"), digest(new).alias("hb"))
    change = F.when(F.col("ka").isNull(), "new").when(F.col("kb").isNull(), "gone").otherwise("changed")
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer").where("NOT (ha <=> hb)")
    return both.select(F.coalesce("ka", "kb").alias(key), change.alias("change"))


def first_wins(lists: list[DataFrame], key: str) -> DataFrame:
    """Union of lists in which the first list that has a key keeps it; ranks start anew in each."""
    rows = reduce(DataFrame.unionByName, [df.select(key, F.lit(i).alias("list")) for i, df in enumerate(lists)])
    rows = rows.groupBy(key).agg(F.min("list").alias("list"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy(key)))


def aggregate(hits: DataFrame, op: str, samples: int = 20, preview: int = 80) -> DataFrame:
    """One aggregate call over hits (id, content, entity, fact_type, source_confidence,
    observed_at): ``count``, ``enumerate``, ``by_entity``, ``sum_currency``,
    ``sum_duration``, ``count_distinct_dates`` or ``timeline``. Lists stop at ``samples`` rows."""
    if op == "count":
        return hits.agg(F.count("*").alias("n"))
    if op == "enumerate":
        return hits.orderBy("id").limit(samples).select("id", "fact_type", shortened(F.col("content"), preview).alias("preview"))
    if op == "by_entity":
        return by_entity(hits, "entity", "source_confidence").orderBy(F.desc("n"), "entity").limit(samples)
    found = hits.select("id", F.explode(slots(F.col("content"), F.col("observed_at"))).alias("s")).select("id", "s.*")
    if op == "sum_currency":
        return found.where("kind = 'currency'").groupBy("unit").agg(F.sum("value").alias("total"), F.count("*").alias("mentions"))
    if op == "sum_duration":
        total = F.sum("value")
        return found.where("kind = 'duration'").agg(
            total.alias("seconds"), F.round(total / 3600, 6).alias("hours"), F.round(total / DAY_S, 6).alias("days"), F.count("*").alias("mentions")
        )
    day = F.date_from_unix_date((F.col("value") / (DAY_S * 1000)).cast("int"))
    dates = found.where("kind = 'event_date'").select("id", F.date_format(day, "yyyy-MM-dd").alias("day"), "raw")
    if op == "count_distinct_dates":
        return dates.agg(F.count_distinct("day").alias("n"))
    if op == "timeline":
        return dates.orderBy("day", "id", "raw").limit(samples)
    raise ValueError(f"no aggregate {op!r}")
