"""Scans, predicates, projections and paging over facts and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.schema import visible_time

DAY = 86_400_000
#: Fact types that stay fresh however old they are.
DURABLE = ("decision", "convention", "preference", "lesson", "pattern")


def in_window(since: int | None = None, until: int | None = None) -> Column:
    """Happened in [since, until], both included."""
    cond = F.lit(True)
    if since is not None:
        cond &= visible_time() >= since
    if until is not None:
        cond &= visible_time() <= until
    return cond


def as_of(t: int | Column) -> Column:
    """Known and not yet superseded at ``t``."""
    return (F.col("created_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t))


def current() -> Column:
    return F.col("superseded_at").isNull()


def fact_list(
    facts: DataFrame,
    fact_type: str | None = None,
    min_confidence: float | None = None,
    entity: str | None = None,
    source_id: str | None = None,
    since: int | None = None,
    until: int | None = None,
    current_only: bool = False,
    at: int | None = None,
) -> DataFrame:
    """Facts that meet every given condition; a null namespace never matches."""
    cond = in_window(since, until)
    if fact_type is not None:
        cond &= F.col("fact_type") == fact_type
    if min_confidence is not None:
        cond &= F.col("source_confidence") >= min_confidence
    if entity is not None:
        cond &= (F.array_contains("entity_ids", entity) if "entity_ids" in facts.columns else F.col("entity") == entity)
    if source_id is not None:
        cond &= F.col("source_id") == source_id
    if current_only:
        cond &= current()
    if at is not None:
        cond &= as_of(at)
    return facts.where(cond)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def multi_get(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows by id in the order of the list, with that place as ``pos``; missing ones are left out."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"pos long, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(wanted), key)  # the list is an argument, so it is small


def prefer(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def visible_entities(entities: DataFrame, facts: DataFrame, source_id: str) -> DataFrame:
    """Entities with at least one fact in the namespace."""
    seen = facts.where(F.col("source_id") == source_id).select(F.col("entity").alias("id"))
    return entities.join(seen, "id", "left_semi")


def redacted(entities: DataFrame) -> DataFrame:
    """What a scoped reader sees of an entity: no tags, no time."""
    return entities.withColumns(
        {"tags": F.array().cast("array<string>"), "updated_at": F.lit(0).cast("long")}
    )


def slim_facts(facts: DataFrame, now: int, preview: int | None = None) -> DataFrame:
    """Compact records: age in days (at least 1), and a warning for stale ones."""
    age = F.greatest(F.lit(1), F.floor((F.lit(now) - F.col("created_at")) / DAY)).cast("long")
    stale = (age >= 60) & ~F.col("fact_type").isin(*DURABLE)
    content = F.col("content") if preview is None else shortened(F.col("content"), preview)
    return facts.select(
        "id", content.alias("content"), "fact_type", "source_id", age.alias("age_days"),
        F.when(stale, F.concat(age.cast("string"), F.lit(" days old: verify before use"))).alias("warning"),
    )


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def first_per_type(facts: DataFrame, types: list[str], n: int) -> DataFrame:
    """The first ``n`` current facts of each of the types."""
    by = Window.partitionBy("fact_type").orderBy("id")
    rows = facts.where(F.col("fact_type").isin(types) & current()).withColumn("pos", F.row_number().over(by))
    return rows.where(F.col("pos") <= n)


def entity_by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Look names up without regard to case; ``names`` has the column ``wanted``."""
    return names.join(entities, F.lower("wanted") == F.lower("name"))


def with_all_tags(entities: DataFrame, tags: list[str], entity_type: str | None = None) -> DataFrame:
    cond = F.lit(True) if entity_type is None else F.col("entity_type") == entity_type
    for t in tags:
        cond &= F.array_contains("tags", t)
    return entities.where(cond)


def edges_at(relations: DataFrame, node: str, direction: str = "both") -> DataFrame:
    out, back = F.col("source_id") == node, F.col("target_id") == node
    return relations.where({"forward": out, "reverse": back, "both": out | back}[direction])


def scoped_edges(relations: DataFrame, scope: str | None) -> DataFrame:
    """Edges of exactly this namespace; None stands for the unscoped ones."""
    return relations.where(F.col("scope").eqNullSafe(F.lit(scope)))


def visible_to(resources: DataFrame, actor: str) -> DataFrame:
    """Handoffs and their contexts are seen by their participants only, and
    their tombstones by nobody; everything else by all. ``body`` is JSON."""
    private = F.col("kind").isin("handoff", "handoff_context")
    who = F.array(F.get_json_object("body", "$.from"), F.get_json_object("body", "$.to"))
    return resources.where(~private | F.coalesce((F.col("operation") != "delete") & F.array_contains(who, actor), F.lit(False)))


def window_start(now: int, last: str | None = None, since: int | None = None) -> int | None:
    """Lower bound of a relative window such as ``36h`` or ``2w``; it wins over ``since``."""
    if last is None:
        return since
    unit = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": DAY, "w": 7 * DAY, "y": 365 * DAY}[last[-1]]
    return now - int(last[:-1]) * unit


def parse_fact_type(raw: str) -> str:
    """The type a caller names; an unknown word is an error, ``unknown`` itself is not."""
    from factlake.schema import FACT_TYPES, TYPE_ALIASES

    low = raw.strip().lower()
    name = TYPE_ALIASES.get(low, low)
    if name not in FACT_TYPES:
        raise ValueError(f"no fact type {raw!r}; known: {', '.join(FACT_TYPES)}")
    return name


def fit_budget(rows: DataFrame, size: Column, budget: int, order: list[Column]) -> DataFrame:
    """The longest prefix, in order, whose total size stays within the budget.

    For results that a ranking has already limited: the window is one task.
    """
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__upto", F.sum(size).over(upto)).where(F.col("__upto") <= budget).drop("__upto")


#: Lengths to which previews shrink, one after the other.
PREVIEWS = (200, 120, 80, 50, 30)


def shrunk(parts: dict[str, DataFrame], budget: int) -> dict[str, DataFrame]:
    """A topic's parts (hits, recent: pos, id, content; related: id) cut to a budget of
    characters: related goes first, previews shrink in steps, recent facts go from the
    tail, then hits, of which the first stays. For results that limits keep few."""
    size = lambda df: df.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    out = dict(parts)
    total = lambda: size(out["hits"]) + size(out["recent"])
    related = out["related"].agg(F.coalesce(F.sum(F.length(F.col("id").cast("string"))), F.lit(0))).first()[0]
    if total() + related <= budget:
        return out
    out["related"] = out["related"].where(F.lit(False))
    for n in PREVIEWS:
        if total() <= budget:
            return out
        for name in ("hits", "recent"):
            out[name] = parts[name].withColumn("content", shortened(F.col("content"), n))
    out["recent"] = fit_budget(out["recent"], F.length("content"), budget - size(out["hits"]), [F.col("pos")])
    if total() > budget:
        rest = fit_budget(out["hits"], F.length("content"), budget, [F.col("pos")])
        out["hits"] = rest if not rest.isEmpty() else out["hits"].orderBy("pos").limit(1)
    return out
