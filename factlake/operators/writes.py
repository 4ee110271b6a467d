"""The write path: prepared rows, hints, patches, entity edits and reviews, as tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.functions import text as x
from factlake.operators import lifecycle as life
from factlake.operators.filters import current, entity_by_name
from factlake.operators.lexjoin import bm25_join
from factlake.staging import cut, small


def prepare(rows: DataFrame, policy: str = "report") -> tuple[DataFrame, DataFrame]:
    """(rows to write, rows held back): blank contents go, a missing fact type is
    inferred from the content, and secrets are reported, redacted or held back."""
    rows = rows.where(F.trim("content") != "")
    kind = F.when(F.coalesce(F.trim("fact_type"), F.lit("")) == "", x.infer_fact_type(F.col("content"))).otherwise(F.col("fact_type"))
    return x.screened(rows.withColumn("fact_type", kind), policy)


def similar_hints(facts: DataFrame, new: DataFrame, least: float = 1.0) -> DataFrame:
    """(id, similar_id, score): for each new row the best current fact of its
    namespace by its own content, if it reaches ``least``."""
    asked = new.select(F.col("id").alias("query_id"), F.col("content").alias("query"), "source_id")
    found = bm25_join(facts.where(current()).select("id", "content", "source_id"), asked, 1, same="source_id")
    return found.where(F.col("score") >= least).select(F.col("query_id").alias("id"), F.col("id").alias("similar_id"), "score")


def write(facts: DataFrame, new: DataFrame, policy: str = "report", ruling: tuple[str, ...] = ("decision", "convention")) -> dict[str, DataFrame]:
    """One call of the write path over facts (id, content, fact_type, entity, entity_ids,
    source_id, created_at, superseded_at, superseded_by).

    ``hints`` are looked up before the write, ``receipts`` say which id each row
    got, ``held`` are the rows that the privacy policy keeps out. Facts of a ruling
    type that are new, not merged into one that was there, supersede the current
    ones that share an entity with them; no other fact changes.
    """
    rows, held = prepare(new, policy)
    rows = rows.select(*facts.columns)
    written, receipts = life.insert(facts, rows)
    return {
        "facts": life.supersede_by_new(written, receipts.where("NOT merged"), list(ruling)), "receipts": receipts, "held": held, "hints": similar_hints(facts, rows),
    }


def _filled(old: str, new: str) -> Column:
    return F.coalesce(F.col(new), F.col(old))


def _folded(changes: DataFrame) -> DataFrame:
    """One change for each id: of several the last value of a column counts, by ``seq`` if they have one."""
    order = ["seq"] if "seq" in changes.columns else []
    names = [c for c in changes.columns if c not in ("id", "seq")]
    rank = F.struct(*order, *names)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"__{c}") for c in names]
    return changes.groupBy("id").agg(*last, *[F.min(c).alias("__seq") for c in order] or [F.lit(0).alias("__seq")])


def patch(facts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, errors): ``changes`` has id and columns of ``facts``, and may have ``seq``,
    their order; null leaves a value. Changes of one id count together.

    The table after all changes is held against itself: where several facts of a
    namespace have one content, one that had it before keeps it, else the first change
    to it by (seq, id); the other changes to it are errors, with the least other id
    that has it, and change nothing. A change of neither content nor namespace stands. What an error leaves in place may clash with a further change,
    so this is repeated until nothing clashes.
    """
    names = [c for c in changes.columns if c not in ("id", "seq")]
    rows = facts.join(_folded(changes), "id", "left")
    after = F.struct(*[_filled(c, f"__{c}").alias(c) if c in names else F.col(c) for c in facts.columns])
    changed = F.col("__seq").isNotNull()
    rows = cut(rows.select(F.struct(*facts.columns).alias("old"), F.when(changed, after).alias("new"), "__seq", F.lit(None).cast(facts.schema["id"].dataType).alias("existing_id")))
    while True:
        taken = F.col("new").isNotNull() & F.col("existing_id").isNull()
        now = F.when(taken, F.col("new")).otherwise(F.col("old"))
        moves = taken & ~((F.col("new.content").eqNullSafe(F.col("old.content"))) & F.col("new.source_id").eqNullSafe(F.col("old.source_id")))
        held = rows.withColumns({"__ns": F.coalesce(now["source_id"], F.lit("\0")), "__h": F.sha2(now["content"], 256), "__at": F.struct(moves.alias("m"), "__seq", F.col("old.id").alias("id"))})
        low = held.groupBy("__ns", "__h").agg(F.min("old.id").alias("__low"), F.min("__at").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
        held = held.join(low, ["__ns", "__h"], "left")
        second = held.where("old.id > __low").groupBy("__ns", "__h").agg(F.min("old.id").alias("__second"))
        held = held.join(second, ["__ns", "__h"], "left")
        other = F.when(F.col("old.id") > F.col("__low"), F.col("__low")).otherwise(F.col("__second"))
        lost = F.coalesce(F.col("__at.m") & (F.col("__first.id") != F.col("old.id")), F.lit(False))
        found = cut(held.select("old", "new", "__seq", F.when(lost, other).otherwise(F.col("existing_id")).alias("existing_id"), lost.alias("lost")))
        rows = found.drop("lost")
        if found.where("lost").isEmpty():
            break
    moves = F.col("new").isNotNull() & F.col("existing_id").isNull()
    out = rows.select(F.when(moves, F.col("new")).otherwise(F.col("old")).alias("x")).select("x.*")
    return out, rows.where("existing_id IS NOT NULL").select("old.id", "existing_id")


def pin(facts: DataFrame, ids: DataFrame, pinned: bool = True) -> DataFrame:
    hit = F.col("__pin").isNotNull()
    rows = facts.join(ids.select("id", F.lit(True).alias("__pin")).distinct(), "id", "left")
    return rows.withColumn("pinned", F.when(hit, F.lit(pinned)).otherwise(F.col("pinned"))).drop("__pin")


# ---- entities --------------------------------------------------------------------


def add_entities(entities: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, errors): a name that is taken, without regard to case, is an error; of equal new names the least id counts."""
    names = entities.select(F.lower("name").alias("__low"), F.col("id").alias("existing_id"))
    rows = new.withColumn("__low", F.lower("name")).join(names, "__low", "left")
    by = Window.partitionBy("__low").orderBy("id")
    fresh = rows.where("existing_id IS NULL").withColumn("__n", F.row_number().over(by))
    errors = rows.where("existing_id IS NOT NULL").select("id", "existing_id").unionByName(
        fresh.where("__n > 1").select("id", F.lit(None).cast("string").alias("existing_id"))
    )
    return entities.unionByName(fresh.where("__n = 1").select(*entities.columns)), errors


def update_entities(entities: DataFrame, changes: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(entities, errors): compare and swap. ``changes`` has id, expected_at and new
    values, null for those that stay: a name renames, aliases are added, a summary
    describes. An edit whose ``expected_at`` is not the stored time is an error, and so
    is a new name that another entity has as its name or alias, without regard to case,
    or that an earlier edit, by id, takes; ``existing_id`` is the owner of the name."""
    names = [c for c in changes.columns if c not in ("id", "expected_at")]
    rows = changes.select("id", "expected_at", *[F.col(c).alias(f"__{c}") for c in names]).join(entities, "id", "left")
    # of several edits of one entity at its time the first, by its values, counts: it moves the time on
    order = Window.partitionBy("id", "expected_at").orderBy(*[f"__{c}" for c in names])
    rows = rows.withColumn("__turn", F.row_number().over(order))
    fits = F.coalesce(F.col("updated_at") == F.col("expected_at"), F.lit(False)) & (F.col("__turn") == 1)
    values = {c: F.array_union(F.coalesce(c, f"__{c}"), F.coalesce(f"__{c}", c)) if c == "aliases" else _filled(c, f"__{c}") for c in names}
    rows = rows.withColumn("__fits", fits).join(_name_clashes(entities, rows.where(fits)), "id", "left").withColumn("existing_id", F.when(F.col("__fits"), F.col("existing_id"))) if "name" in names else rows.withColumns({"__fits": fits, "existing_id": F.lit(None).cast("string")})
    good = F.col("__fits") & F.col("existing_id").isNull()
    done = rows.where(good).withColumns(values | {"updated_at": F.lit(at)}).select(*entities.columns)
    kept = entities.join(done.select("id"), "id", "left_anti")
    return kept.unionByName(done), rows.where(~good).select("id", "expected_at", "updated_at", "existing_id")


def _name_clashes(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, existing_id) of edits whose new name (__name) belongs to another entity or an earlier edit."""
    wanted = edits.where("__name IS NOT NULL").select("id", F.lower("__name").alias("low"))
    called = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in entities.columns else F.array("name")
    owners = entities.select(F.col("id").alias("owner"), F.explode(called).alias("c")).select(F.lower("c").alias("low"), "owner", F.lit(0).alias("new"))
    owners = owners.unionByName(wanted.select("low", F.col("id").alias("owner"), F.lit(1).alias("new")))
    # the least other owner of a name, of those from before first, and of new ones only an earlier one
    clash = wanted.join(owners, "low").where("owner <> id AND (new = 0 OR owner < id)")
    return clash.groupBy("id").agg(F.min(F.struct("new", "owner"))["owner"].alias("existing_id"))


def delete_entities(tables: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """``entities``, ``relations`` and ``bridge`` without the named entities, their edges and their links."""
    gone = small(entity_by_name(tables["entities"], names).select("id").distinct())
    of = lambda c: gone.select(F.col("id").alias(c))
    edges = tables["relations"].join(of("source_id"), "source_id", "left_anti").join(of("target_id"), "target_id", "left_anti")
    return {
        "entities": tables["entities"].join(gone, "id", "left_anti"), "relations": edges.select(*tables["relations"].columns),
        "bridge": tables["bridge"].join(of("entity_id"), "entity_id", "left_anti").select(*tables["bridge"].columns),
    }


def get_or_fuzzy(entities: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """(wanted, id, name, similarity): the entity of exactly that name, else the most similar one from ``least`` on.

    Trigrams block the fuzzy part: a pair without a common one never meets.
    """
    exact = entity_by_name(entities, names).groupBy("wanted").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id"), F.lit(1.0).alias("similarity"))
    rest = names.join(exact.select("wanted"), "wanted", "left_anti")
    near = similar_names(entities, rest, least, inclusive=True)
    by = Window.partitionBy("wanted").orderBy(F.desc("similarity"), "id")
    best = near.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
    return exact.select("wanted", "id", "name", "similarity").unionByName(best)


def similar_names(entities: DataFrame, names: DataFrame, least: float, inclusive: bool = False) -> DataFrame:
    """(wanted, id, name, similarity) of pairs above ``least``, by shared trigrams."""
    a = names.select("wanted").distinct().withColumn("ga", x.trigrams(F.col("wanted")))
    b = entities.select("id", "name", x.trigrams(F.col("name")).alias("gb"))
    met = a.select("wanted", F.size("ga").alias("na"), F.explode("ga").alias("g")).join(
        b.select("id", "name", F.size("gb").alias("nb"), F.explode("gb").alias("g")), "g"
    )
    shared = met.groupBy("wanted", "id", "name", "na", "nb").agg(F.count("*").alias("s"))
    rows = shared.select("wanted", "id", "name", F.round(F.col("s") / (F.col("na") + F.col("nb") - F.col("s")), 6).alias("similarity"))
    return rows.where(F.col("similarity") >= least if inclusive else F.col("similarity") > least)


def suggestions(entities: DataFrame, names: DataFrame, n: int = 5, above: float = 0.5) -> DataFrame:
    """(wanted, pos, name): up to ``n`` similar names of each that was not found."""
    by = Window.partitionBy("wanted").orderBy(F.desc("similarity"), "id")
    rows = similar_names(entities, names, above).withColumn("pos", F.row_number().over(by))
    return rows.where(F.col("pos") <= n).select("wanted", "pos", "name")


# ---- review and sessions ----------------------------------------------------------


def review(pending: DataFrame, verdicts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(committed, kept, summary) of pending entries (idx, content, source_id, ...) by
    verdicts (idx, verdict): ``commit`` writes, ``discard`` drops, no verdict keeps.

    A commit fails, and its entry is kept, if the content is blank.
    """
    first = verdicts.groupBy("idx").agg(F.min("verdict").alias("verdict"))  # commit before discard
    rows = pending.join(first, "idx", "left").withColumn("verdict", F.coalesce("verdict", F.lit("keep")))
    blank = F.coalesce(F.trim("content"), F.lit("")) == ""
    state = F.when((F.col("verdict") == "commit") & blank, "failed").otherwise(F.col("verdict"))
    rows = rows.withColumn("state", state)
    committed = rows.where("state = 'commit'").select(*pending.columns)
    kept = rows.where("state IN ('keep', 'failed')").select(*pending.columns)
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    summary = rows.agg(
        n("commit", "failed").alias("attempted"), n("commit").alias("committed"), n("failed").alias("failed"),
        n("discard").alias("discarded"), n("keep", "failed").alias("remaining"),
    )
    return committed, kept, summary


def continue_sessions(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """``relations`` with the ``continued_from`` edge of each session to the one before; ``pairs`` has session and parent.

    A session has one parent: of several the least counts, and a new one replaces an old one.
    """
    from factlake.operators.graph import upsert_edges

    columns = ["source_id", "relation_type", "target_id", "scope", "weight"]
    one = pairs.where("session <> parent").groupBy(F.col("session").alias("source_id")).agg(F.min("parent").alias("target_id"))
    edges = one.select("source_id", F.lit("continued_from").alias("relation_type"), "target_id", F.lit(None).cast("string").alias("scope"), F.lit(1.0).alias("weight"))
    old = relations.select(*columns)
    stale = (F.col("relation_type") == "continued_from") & F.col("__new")
    kept = old.join(one.select("source_id", F.lit(True).alias("__new")), "source_id", "left").where(~F.coalesce(stale, F.lit(False))).select(*columns)
    return upsert_edges(kept, edges.select(*columns))


def mined_edges(facts: DataFrame, bridge: DataFrame, existing: DataFrame, k: int = 3, least: float = 1.0) -> DataFrame:
    """(source_id, target_id, scope, weight): entities of facts with like contents.

    Each fact asks by its own content for the ``k`` best others that are current
    and in its namespace; those from ``least`` on relate its entities to theirs,
    unless the edge exists in that scope or both are one. The best score weighs.
    """
    asked = facts.select(F.col("id").alias("query_id"), F.col("content").alias("query"), "source_id")
    found = bm25_join(facts.where(current()).select("id", "content", "source_id"), asked, k, same="source_id", but_own=True)
    near = found.where(F.col("score") >= least).join(facts.select(F.col("id").alias("query_id"), F.col("source_id").alias("scope")), "query_id")
    of = lambda key, name: bridge.select(F.col("fact_id").alias(key), F.col("entity_id").alias(name))
    pairs = near.join(of("query_id", "source_id"), "query_id").join(of("id", "target_id"), "id").where("source_id <> target_id")
    edges = pairs.groupBy("source_id", "target_id", "scope").agg(F.max("score").alias("weight"))
    old = existing.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("scope").alias("c"))
    return edges.join(old, (F.col("source_id") == F.col("s")) & (F.col("target_id") == F.col("t")) & F.col("scope").eqNullSafe(F.col("c")), "left_anti")
