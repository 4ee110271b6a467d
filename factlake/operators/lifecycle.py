"""Writes as functions from tables to tables: insert, supersede, merge, archive, consolidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators.graph import components
from factlake.operators.similarity import similar_pairs


def insert(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, receipts) after an insert with exact deduplication.

    A fact whose namespace and content already exist keeps the old id, and both
    entity lists are united; receipts say which id each input id got.
    """
    hashed = lambda df: df.withColumn("__h", F.sha2("content", 256)).withColumn("__ns", F.coalesce("source_id", F.lit("\0")))
    both = hashed(existing).withColumn("__new", F.lit(0)).unionByName(hashed(new).withColumn("__new", F.lit(1)))
    ids = both.groupBy("__ns", "__h").agg(
        F.min(F.struct("__new", "id")).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("entity_ids")))).alias("__entities"),
    )
    rows = both.join(ids, ["__ns", "__h"])
    kept = rows.where(F.struct("__new", "id") == F.col("first")).withColumn("entity_ids", F.col("__entities"))
    receipts = rows.where("__new = 1").select("id", F.col("first.id").alias("stored_id"), (F.struct("__new", "id") != F.col("first")).alias("merged"))
    return kept.select(*existing.columns), receipts


def resolve_conflicts(facts: DataFrame, types: list[str]) -> DataFrame:
    """Of the current facts of a ruling type on one entity in one namespace the
    latest stays; it supersedes the others. For tables that were never resolved;
    ``supersede_by_new`` is the rule of a write."""
    keys = ["entity", "fact_type", "source_id"]
    live = F.col("superseded_at").isNull() & F.col("fact_type").isin(types)
    # the latest of each key comes from a sum of partial ones, so that no task holds all facts of a key
    best = facts.where(live).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.struct("created_at", "id")).alias("__best"))
    on = live
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = facts.join(best, on, "left")
    lost = F.coalesce(live & (F.col("__best.id") != F.col("id")), F.lit(False))
    return rows.withColumns(
        {
            "superseded_by": F.when(lost, F.col("__best.id")).otherwise(F.col("superseded_by")),
            "superseded_at": F.when(lost, F.col("__best.created_at")).otherwise(F.col("superseded_at")),
        }
    ).select(*facts.columns)


def supersede_by_new(facts: DataFrame, new: DataFrame, types: list[str]) -> DataFrame:
    """``facts`` after rulings ``new`` (id) of them were added one by one, in order of time and id.

    Each supersedes the current facts of its type and namespace that share one of
    its entities: those from before, and those added earlier. So a fact is
    superseded by the first such ruling after it. Facts on no entity, and facts
    that share nothing with a new one, stay as they are.
    """
    live = facts.where(F.col("superseded_at").isNull() & F.col("fact_type").isin(types))
    fresh = new.select("id", F.lit(True).alias("__new")).distinct()
    each = live.join(fresh, "id", "left").select(
        "id", F.struct("created_at", "id").alias("at"), F.coalesce("__new", F.lit(False)).alias("fresh"), "fact_type",
        F.coalesce("source_id", F.lit("\0")).alias("ns"), F.explode(F.array_distinct("entity_ids")).alias("entity_id"),
    )
    keys = ["entity_id", "fact_type", "ns"]
    first = each.where("fresh").groupBy(*keys).agg(F.min("at").alias("by"))
    older = each.where("NOT fresh").join(first, keys).select("id", "by")
    later = Window.partitionBy(*keys).orderBy("at")
    chain = each.where("fresh").select("id", F.lead("at").over(later).alias("by")).where("by IS NOT NULL")
    lost = older.unionByName(chain).groupBy("id").agg(F.min("by").alias("__by"))
    return facts.join(lost, "id", "left").withColumns(
        {
            "superseded_by": F.coalesce("__by.id", "superseded_by"),
            "superseded_at": F.coalesce("__by.created_at", "superseded_at"),
        }
    ).select(*facts.columns)


def supersede(facts: DataFrame, pairs: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(facts, errors): apply (old_id, new_id); a fact that is already superseded is an error."""
    marks = pairs.groupBy(F.col("old_id").alias("__old")).agg(F.min("new_id").alias("__new"))
    rows = facts.join(marks, F.col("id") == F.col("__old"), "left")
    fresh = F.col("__old").isNotNull() & F.col("superseded_at").isNull()
    errors = rows.where(F.col("__old").isNotNull() & F.col("superseded_at").isNotNull()).select("id", "superseded_by")
    out = rows.withColumns(
        {
            "superseded_by": F.when(fresh, F.col("__new")).otherwise(F.col("superseded_by")),
            "superseded_at": F.when(fresh, F.lit(at)).otherwise(F.col("superseded_at")),
        }
    )
    return out.select(*facts.columns), errors


def expired(facts: DataFrame, ttl_days: dict[str, int], now: int) -> DataFrame:
    """Current facts older than the time their type lives."""
    life = F.lit(None).cast("long")
    for kind, days in ttl_days.items():
        life = F.when(F.col("fact_type") == kind, F.lit(days * 86_400_000)).otherwise(life)
    return facts.where(F.col("superseded_at").isNull() & (F.col("created_at") + life < now))


def semantic_dedup(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, superseded_by): an older fact is superseded by its earliest newer neighbour.

    Ids stand for age. Longer chains keep only their newest member current.
    """
    return similar_pairs(vectors, threshold).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("superseded_by"))


def consolidate(vectors: DataFrame, threshold: float, budget: int = 0) -> DataFrame:
    """(id, cluster, size, tight, keep) of every clustered vector.

    Clusters are components at the threshold. A tight one (mean pairwise
    distance under 1 - threshold) keeps its newest member; a spread one its
    medoid and the ``budget`` members with the largest summed distance. Sums
    over all pairs of a cluster come from the sum of its unit vectors, so no
    pairs are made.
    """
    from factlake.operators.ranking import dot, normalised

    pairs = similar_pairs(vectors, threshold)
    member = components(pairs.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    heads = member.select(F.col("cluster").alias("id"), "cluster").distinct()
    member = member.unionByName(heads).distinct()
    rows = member.join(vectors.select("id", normalised(F.col("v")).alias("u")), "id")
    d = F.posexplode("u").alias("k", "x")
    centre = rows.select("cluster", d).groupBy("cluster", "k").agg(F.sum("x").alias("x"))
    centre = centre.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))
    size = member.groupBy("cluster").agg(F.count("*").alias("size"))
    rows = rows.join(centre, "cluster").join(size, "cluster")
    # sum over others of (1 - cos): n - 1 - (u . c - 1)
    total = F.round(F.col("size") - dot(F.col("u"), F.col("c")), 9)
    rows = rows.withColumn("total", total)
    of = Window.partitionBy("cluster")
    mean = F.sum("total").over(of) / (F.col("size") * (F.col("size") - 1))
    tight = mean < 1 - threshold
    newest = F.col("id") == F.max("id").over(of)
    near = F.row_number().over(of.orderBy("total", "id")) == 1
    far = F.row_number().over(of.orderBy(F.desc("total"), "id"))
    rows = rows.withColumns({"tight": tight, "newest": newest, "medoid": near, "far": far})
    keep = F.when(F.col("tight"), F.col("newest")).otherwise(F.col("medoid") | (F.col("far") <= budget))
    return rows.select("id", "cluster", "size", "tight", keep.alias("keep"))


def archive(hot: DataFrame, cold: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) after moving ``ids``; moving again changes nothing."""
    moved = hot.join(ids, "id", "left_semi")
    left = hot.join(ids, "id", "left_anti")
    return left, moved.unionByName(cold.join(moved.select("id"), "id", "left_anti"))


def delete(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids, "id", "left_anti")


def feedback(facts: DataFrame, votes: DataFrame, start: float = 0.5) -> DataFrame:
    """(id, relevance_score): +0.10 or -0.15 per vote in time order, clamped to
    [0, 1] after each. ``votes`` has fact_id, helpful, at; the order matters, so a
    fact's votes are folded in one row."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "helpful")))
    moved = F.aggregate(
        ordered, F.lit(start), lambda s, x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s + F.when(x["helpful"], 0.10).otherwise(-0.15)))
    )
    scores = votes.groupBy(F.col("fact_id").alias("id")).agg(F.round(moved, 6).alias("relevance_score"))
    return facts.select("id").join(scores, "id")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def lww_merge(local: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Last writer wins by ``updated_at``; the local row stays on equal times, and
    an incoming row is dropped if another id has its namespace and content."""
    taken = local.select(F.coalesce("source_id", F.lit("\0")).alias("__ns"), F.sha2("content", 256).alias("__h"), F.col(key).alias("__id"))
    same = (F.coalesce("source_id", F.lit("\0")) == F.col("__ns")) & (F.sha2("content", 256) == F.col("__h")) & (F.col(key) != F.col("__id"))
    fresh = incoming.join(taken, same, "left_anti")
    both = local.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)))
    return latest_by(both, [key], [F.desc("updated_at"), F.col("__p")]).drop("__p")


def lww_entities(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """The same for entities; a new entity is dropped if its name is taken."""
    names = local.select(F.lower("name").alias("__name"), F.col("id").alias("__id"))
    fresh = incoming.join(names, (F.lower("name") == F.col("__name")) & (F.col("id") != F.col("__id")), "left_anti")
    both = local.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)))
    return latest_by(both, ["id"], [F.desc("updated_at"), F.col("__p")]).drop("__p")


def resolve_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(wanted, id, created): existing ids by name, or a new one for each missing name."""
    known = entities.groupBy(F.lower("name").alias("__low")).agg(F.min("id").alias("id"))
    rows = names.select("wanted").distinct().join(known, F.lower("wanted") == F.col("__low"), "left")
    made = F.concat(F.lit("new:"), F.substring(F.sha2(F.lower("wanted"), 256), 1, 16))
    return rows.select("wanted", F.coalesce("id", made).alias("id"), F.col("id").isNull().alias("created"))


def handoff_states(events: DataFrame, now: int, lease: int) -> DataFrame:
    """(id, state, holder, revision, lane): fold of each handoff's events.

    pending -> accepted by the first accept -> completed by a return of its
    holder; a heartbeat of the holder extends the lease while it lives, and an
    accept after it ran out takes over. ``events`` has id, at, action, actor.
    """
    zero = F.struct(F.lit("none").alias("state"), F.lit(None).cast("string").alias("holder"), F.lit(0).alias("revision"), F.lit(None).cast("long").alias("expires"))

    def step(s: Column, e: Column) -> Column:
        live = F.coalesce(s["expires"] > e["at"], F.lit(False))
        mine = F.coalesce(s["holder"] == e["actor"], F.lit(False))
        to = lambda state, holder, expires: F.struct(state.alias("state"), holder.alias("holder"), (s["revision"] + 1).alias("revision"), expires.alias("expires"))
        none = F.lit(None).cast("string")
        return (
            F.when((e["action"] == "dispatch") & (s["state"] == "none"), to(F.lit("pending"), none, F.lit(None).cast("long")))
            .when((e["action"] == "accept") & ((s["state"] == "pending") | ((s["state"] == "accepted") & ~live)), to(F.lit("accepted"), e["actor"], e["at"] + lease))
            .when((e["action"] == "heartbeat") & (s["state"] == "accepted") & mine & live, to(s["state"], s["holder"], e["at"] + lease))
            .when((e["action"] == "return") & (s["state"] == "accepted") & mine, to(F.lit("completed"), s["holder"], F.lit(None).cast("long")))
            .otherwise(s)
        )

    ordered = F.sort_array(F.collect_list(F.struct("at", "seq", "action", "actor")))
    rows = events.groupBy("id").agg(F.aggregate(ordered, zero, step).alias("s")).select("id", "s.*")
    lane = (
        F.when(F.col("state") == "pending", "ready").when(F.col("state") == "completed", "returned")
        .when((F.col("state") == "accepted") & (F.col("expires") <= now), "attention").when(F.col("state") == "accepted", "in_progress").otherwise("none")
    )
    return rows.select("id", "state", "holder", "revision", lane.alias("lane"))


def board(states: DataFrame) -> DataFrame:
    return states.groupBy("lane").agg(F.count("*").alias("n"))
