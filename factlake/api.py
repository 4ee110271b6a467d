"""One object over the tables of a store, with the calls its users know.

Every call returns a DataFrame, or a dict of them, and runs nothing that its
caller does not ask for; only ``adaptive_search`` runs a small probe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import candidates
from factlake.operators import aggregates as a
from factlake.operators import filters as f
from factlake.operators import graph as g
from factlake.operators import lifecycle as life
from factlake.operators import lint
from factlake.operators import ranking as r
from factlake.operators import writes as w
from factlake.operators.changes import branch_changes

#: Sections of a handoff packet and the fact types in them.
SECTIONS = [
    ("Decisions", ["decision", "convention", "pattern"]), ("Open questions", ["question"]), ("Lessons", ["lesson", "error"]),
]


@dataclass
class Memory:
    """``facts`` need id, content, fact_type, entity, source_id, created_at,
    observed_at, superseded_at, pinned; entities id, name, entity_type, tags."""

    facts: DataFrame
    entities: DataFrame
    bridge: DataFrame
    relations: DataFrame

    def search(self, query: str, limit: int = 10, where: Column | None = None) -> DataFrame:
        """Lexical hits of current facts, best first."""
        cond = f.current() if where is None else f.current() & where
        return r.bm25(self.facts, query, limit, where=cond)

    def adaptive_search(self, query: str, vectors: DataFrame, target: list[float], limit: int = 10) -> DataFrame:
        """Lexical if its probe is strong enough, else fused with vectors (id, v)."""
        probe = self.search(query, max(limit, 200))
        cjk = any(0x1100 <= ord(c) <= 0x11FF or 0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7AF for c in query)
        if not r.promotes(probe, limit, cjk):
            return probe.where(F.col("rank") <= limit).select("id", "score", "rank")
        scored = vectors.select("id", r.cosine(F.col("v"), r.literal_vector(target)).alias("score"))
        both = r.fused(probe.select("id", "score", "rank"), r.top(scored, [F.desc("score"), F.col("id")], 200))
        return r.top(both.select("id", "best_rank", F.col("base").alias("score")), [F.desc("score"), F.col("best_rank"), F.col("id")], limit).drop("best_rank")

    def hybrid_search(
        self, query: str, vectors: DataFrame, target: list[float], limit: int = 10, scorer: Column | None = None, rerank_k: int = 15,
        w_lexical: float | None = None, w_semantic: float | None = None, cold: DataFrame | None = None,
    ) -> DataFrame:
        """(id, score, rank) of both legs fused by weights, 1 and 0.5 where none is given, the head ordered anew by
        ``scorer``; with a cold tier the hits of its texts follow in one ranking, and rows have their tier."""
        scored = vectors.select("id", r.cosine(F.col("v"), r.literal_vector(target)).alias("score"))
        legs = self.search(query, 200).select("id", "score", "rank"), r.top(scored, [F.desc("score"), F.col("id")], 200)
        hits = r.hybrid(*legs, limit, scorer, rerank_k, (r.weight_or(w_lexical, 1.0), r.weight_or(w_semantic, 0.5)))
        if cold is None:
            return hits
        far = r.bm25(cold, query, 200).select("id", (1.0 / (r.RRF_K + F.col("rank"))).alias("score"))
        return r.with_archive(hits, far, limit)

    def fact_list(self, limit: int = 100, offset: int = 0, **conditions) -> DataFrame:
        return f.page(f.fact_list(self.facts, **conditions), [F.col("id")], limit, offset)

    def fact_get(self, ids: list) -> DataFrame:
        return f.multi_get(self.facts, ids)

    def entity_get(self, name: str) -> DataFrame:
        wanted = self.entities.sparkSession.createDataFrame([(name,)], "wanted string")
        return f.entity_by_name(self.entities, wanted)

    def entity_list(self, limit: int = 100) -> DataFrame:
        return f.page(a.entity_counts(self.entities, self.bridge), [F.desc("fact_count"), F.col("id")], limit)

    def traverse(self, start: str, depth: int = 2, direction: str = "forward", types: list[str] | None = None) -> dict[str, DataFrame]:
        first = self.entities.sparkSession.createDataFrame([(start,)], "id string")
        inside, edges, visited = g.traverse(self.relations, first, depth, direction, types)
        return {"entities": inside, "relations": edges, "visited": visited.agg(F.count("*").alias("visited_count"))}

    def path(self, start: str, goal: str) -> DataFrame:
        return g.shortest_path(self.relations, start, goal)

    def recent(self, now: int, last: str = "7d", limit: int = 50, order: str = "asc") -> DataFrame:
        """Oldest first by default, newest first with ``desc``."""
        by = F.col("id") if order == "asc" else F.desc("id")
        return f.page(self.facts.where(f.in_window(f.window_start(now, last))), [by], limit)

    def pinned(self, limit: int = 20, source_id: str | None = None) -> DataFrame:
        return f.page(f.fact_list(self.facts, source_id=source_id).where("pinned"), [F.desc("created_at"), F.col("id")], limit)

    def overview(self, since: int = 0) -> dict[str, DataFrame]:
        return {
            "stats": a.stats(self.facts, self.entities, self.relations), "entity_types": a.type_buckets(self.entities, 3),
            "fact_types": a.fact_buckets(self.facts, since), "top_entities": self.entity_list(12),
            "orphans": lint.orphans(self.entities, self.relations, self.bridge).agg(F.count("*").alias("n")),
        }

    def doctor(self, now: int, types: list[str]) -> DataFrame:
        return lint.rollup(lint.report(self.entities, self.relations, self.bridge, self.facts, now, types))

    def query(self, topic: str, mode: str = "local", depth: int = 1, limit: int = 10) -> dict[str, DataFrame]:
        """A topic from several sides: hits, the entity, what is around it, its recent facts.

        ``naive`` is hits only, ``local`` leaves hits out, ``hybrid`` has both,
        and ``global`` goes four steps and 200 facts at least.
        """
        if mode == "global":
            depth, limit = max(depth, 4), max(limit, 200)
        out = {} if mode == "local" else {"hits": self.search(topic, limit)}
        if mode != "naive":
            entity = self.entity_get(topic)
            steps = g.reach(self.relations, entity.select("id"), depth, "both")
            own = self.facts.join(entity.select(F.col("id").alias("entity")), "entity", "left_semi")
            out |= {"entity": entity, "around": steps, "recent": f.page(own, [F.desc("created_at"), F.desc("id")], limit)}
        return out

    def session_start(self, now: int, types: list[str]) -> dict[str, DataFrame]:
        return {
            "stats": a.stats(self.facts, self.entities, self.relations), "pinned": self.pinned(), "recent": self.recent(now),
            "top_entities": self.entity_list(10), "issues": self.doctor(now, types),
        }

    def context(self, topic: str, now: int, n: int = 5) -> dict[str, DataFrame]:
        hits = self.search(topic, 30)
        return {
            "pinned": self.pinned(), "personal": f.first_per_type(self.facts, ["preference", "lesson", "error"], n),
            "recent": self.recent(now), "hits": hits, "lessons": hits.where("fact_type IN ('lesson', 'error')").limit(n),
        }

    def workflow_start(self, ticket: str, text: str, now: int) -> dict[str, DataFrame]:
        """A session entity and its ticket fact to write, and what is known about it."""
        spark = self.facts.sparkSession
        session = spark.createDataFrame([(f"session:{ticket}", ticket, "session", [f"ticket:{ticket}"], now)], "id string, name string, entity_type string, tags array<string>, updated_at long")
        fact = spark.createDataFrame([(text, "note", f"session:{ticket}", now)], "content string, fact_type string, entity string, created_at long")
        hits = self.search(text, 30)
        kinds = {k: hits.where(F.col("fact_type") == k).limit(5) for k in ("lesson", "error", "decision")}
        return {"session": session, "fact": fact, "hits": hits} | kinds

    def profile(self) -> dict[str, DataFrame]:
        order = [F.desc("source_confidence"), F.col("id")]
        return {"entities": self.entity_list(12), "facts": a.top_per(self.facts.where(f.current()), ["fact_type"], order, 20)}

    def feedback(self, votes: DataFrame) -> DataFrame:
        """(id, relevance_score) after votes (fact_id, helpful, at)."""
        return life.feedback(self.facts, votes)

    def fact_pin(self, ids: DataFrame, pinned: bool = True) -> DataFrame:
        return w.pin(self.facts, ids, pinned)

    def fact_edit(self, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(facts, errors) after changes (id and new values, null for those that stay)."""
        return w.patch(self.facts, changes)

    def fact_archive(self, cold: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        return life.archive(self.facts, cold, ids)

    def entity_describe(self, edits: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
        """(entities, errors) after edits (id, expected_at, new values): rename, alias, describe."""
        return w.update_entities(self.entities, edits, at)

    def entity_delete(self, names: DataFrame) -> dict[str, DataFrame]:
        return w.delete_entities({"entities": self.entities, "relations": self.relations, "bridge": self.bridge}, names)

    def entity_find(self, names: DataFrame) -> DataFrame:
        """The exact entity of each name (wanted), else the most similar one."""
        return w.get_or_fuzzy(self.entities, names)

    def extract(self, texts: DataFrame, names: list[str]) -> DataFrame:
        return candidates(texts, names)

    def aggregate(self, op: str, where: Column | None = None, samples: int = 20) -> DataFrame:
        """One of the aggregate operations over current facts that ``where`` picks."""
        cond = f.current() if where is None else f.current() & where
        return a.aggregate(self.facts.where(cond), op, samples)

    def aggregate_many(self, requests: dict[str, tuple[str, Column]], samples: int = 20) -> dict[str, DataFrame]:
        return {name: self.aggregate(op, where, samples) for name, (op, where) in requests.items()}

    def search_many(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, query), in one pass over the facts."""
        return r.bm25_many(self.facts.where(f.current()), queries, limit)

    def query_many(self, topics: list[str], **options) -> dict[str, dict[str, DataFrame]]:
        return {topic: self.query(topic, **options) for topic in topics}

    def search_with_archive(self, query: str, cold: DataFrame, limit: int = 10) -> DataFrame:
        """(id, score, tier, rank) of hot and cold hits in one ranking."""
        return r.with_archive(self.search(query, limit), r.bm25(cold, query, limit), limit)

    def coverage_by(self, keys: list[str]) -> DataFrame:
        return a.coverage(self.facts, keys)

    def group_by_entity(self) -> DataFrame:
        """Facts per entity, a fact of several counting for each."""
        return self.bridge.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_fact"))

    def dedupe_by_fact(self) -> DataFrame:
        return a.latest(self.facts, ["content"], [F.col("id")])

    def handoff_inbox(self, source_id: str, limit: int = 25) -> DataFrame:
        return f.page(f.fact_list(self.facts, source_id=source_id), [F.desc("created_at"), F.desc("id")], limit)

    def branch_push(self, branch: DataFrame, at: int) -> DataFrame:
        """Rows of a branch (id, ..., updated_at) that are new or differ, with a later time."""
        return branch_changes(self.facts, branch, at)

    def branch_merge(self, changed: DataFrame) -> DataFrame:
        return life.lww_merge(self.facts, changed)

    def write(self, rows: DataFrame, policy: str = "report") -> dict[str, DataFrame]:
        """The whole write path: prepare, hints, deduplicated insert, conflict resolution."""
        return w.write(self.facts, rows, policy)

    def supersede(self, pairs: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
        return life.supersede(self.facts, pairs, at)

    def remember(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Insert rows (id, content, source_id, entity_ids, ...) of the same columns; blank ones are dropped."""
        return life.insert(self.facts, rows.where(F.trim("content") != ""))


def canvas(session: str, facts: DataFrame) -> DataFrame:
    """One row: a session's facts as a Mermaid thread and a list of evidence.

    For the facts of one session, which a limit keeps few.
    """
    rows = F.sort_array(F.collect_list(F.struct("created_at", "id", "fact_type", "content")))
    node = lambda x: F.concat(F.lit("  s --> f"), x["id"], F.lit('["'), x["fact_type"], F.lit('"]'))
    line = lambda x: F.concat(F.lit("- "), x["fact_type"], F.lit(": "), x["content"])
    text = F.concat(F.lit(f"graph TD\n  s[{session}]\n"), F.array_join(F.transform(rows, node), "\n"), F.lit("\n\n"), F.array_join(F.transform(rows, line), "\n"))
    return facts.agg(text.alias("text"))


def handoff_packet(to: str, focus: str, done_when: str, facts: DataFrame) -> DataFrame:
    """One row: routing, focus, done-when, then facts in four sections."""
    rows = F.sort_array(F.collect_list(F.struct("created_at", "id", "fact_type", "content")))
    known = [k for _, kinds in SECTIONS for k in kinds]

    def section(title: str, keep) -> Column:
        lines = F.transform(F.filter(rows, keep), lambda x: F.concat(F.lit("- "), x["content"]))
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(lines, "\n"))).otherwise("")

    parts = [section(title, _of(kinds)) for title, kinds in SECTIONS]
    rest = section("Notes", lambda x: ~x["fact_type"].isin(*known))
    head = F.lit(f"To: {to}\nFocus: {focus}\nDone when: {done_when}")
    return facts.agg(F.concat(head, *parts, rest).alias("text"))


def _of(kinds: list[str]):
    return lambda x: x["fact_type"].isin(*kinds)
