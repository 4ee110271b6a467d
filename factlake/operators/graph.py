"""Graph operators as loops of joins over (source_id, relation_type, target_id).

Each loop is level-synchronous and checkpoints every level; the number of
levels is the depth asked for, never the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.staging import cut


def steps(relations: DataFrame, direction: str = "forward", types: list[str] | None = None) -> DataFrame:
    """(a, relation_type, b): the moves that a direction allows."""
    r = relations if types is None else relations.where(F.col("relation_type").isin(types))
    out = r.select(F.col("source_id").alias("a"), "relation_type", F.col("target_id").alias("b"))
    back = r.select(F.col("target_id").alias("a"), "relation_type", F.col("source_id").alias("b"))
    return {"forward": out, "reverse": back, "both": out.unionByName(back)}[direction].distinct()


def scoped(relations: DataFrame, visible: DataFrame, scope: str) -> DataFrame:
    """Edges of the namespace between entities visible in it (``visible`` has id)."""
    ends = relations.where(F.col("scope") == scope)
    for c in ("source_id", "target_id"):
        ends = ends.join(visible.select(F.col("id").alias(c)), c, "left_semi")
    return ends


def reach(relations: DataFrame, start: DataFrame, depth: int, direction: str = "forward", types: list[str] | None = None) -> DataFrame:
    """(id, depth) of all nodes within ``depth`` steps of ``start`` (id), by breadth."""
    moves = cut(steps(relations, direction, types))
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    front = seen
    for level in range(1, depth + 1):
        front = front.join(moves, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        front = cut(front.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def traverse(relations: DataFrame, start: DataFrame, depth: int, direction: str = "forward", types: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, visited): nodes within ``depth``; edges with an end
    in them along the direction; nodes within ``depth + 1``."""
    visited = reach(relations, start, depth + 1, direction, types)
    inside = visited.where(F.col("depth") <= depth)
    r = relations if types is None else relations.where(F.col("relation_type").isin(types))
    near = inside.select("id")
    out = r.join(near, r.source_id == near.id, "left_semi")
    back = r.join(near, r.target_id == near.id, "left_semi")
    edges = {"forward": out, "reverse": back, "both": out.unionByName(back).distinct()}[direction]
    return inside, edges, visited


def shortest_path(relations: DataFrame, start: str, goal: str, depth: int | None = None) -> DataFrame:
    """One row (path array<struct<source_id, relation_type, target_id>>): the
    shortest forward path, of equally long ones the first by its ids; an empty
    path if start and goal are one; no row if there is none (within ``depth``, if
    one is given). The search ends when no new node is reached."""
    spark = relations.sparkSession
    moves = cut(steps(relations))
    kind = "array<struct<source_id:string,relation_type:string,target_id:string>>"
    front = spark.createDataFrame([(start,)], "id string").withColumn("path", F.array().cast(kind))
    seen = front.select("id")
    level = 0
    while depth is None or level <= depth:
        level += 1
        hit = front.where(F.col("id") == goal)
        if not hit.isEmpty():
            return hit.select("path")
        step = F.struct(F.col("a").alias("source_id"), "relation_type", F.col("b").alias("target_id"))
        new = front.join(moves, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.concat("path", F.array(step)).alias("path"))
        # arrays of structs compare item by item, so the least one is the first by ids
        new = new.join(seen, "id", "left_anti")
        front = cut(new.groupBy("id").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("id"))
    return front.where(F.lit(False)).select("path")


def simple_paths(relations: DataFrame, start: DataFrame, goal: Column, depth: int) -> DataFrame:
    """(path array<string>): node paths of up to ``depth`` forward steps, without a
    repeated node, from ``start`` (id) to nodes ``id`` for which ``goal`` holds."""
    moves = cut(steps(relations).select("a", "b").distinct())
    front = start.select("id", F.array("id").alias("path"))
    found = front.where(F.lit(False)).select("path")
    for _ in range(depth):
        new = front.join(moves, (F.col("id") == F.col("a")) & ~F.array_contains("path", F.col("b")))
        front = cut(new.select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path")))
        found = found.unionByName(front.where(goal).select("path"))
    return found


def on_cycles(relations: DataFrame) -> DataFrame:
    """Edges that remain when nodes without a way in or out are dropped, repeatedly."""
    e = cut(steps(relations).select("a", "b").distinct())
    n = e.count()
    while n:
        heads, tails = e.select(F.col("b").alias("a")).distinct(), e.select(F.col("a").alias("b")).distinct()
        e = cut(e.join(heads, "a", "left_semi").join(tails, "b", "left_semi").select("a", "b"))
        m = e.count()
        if m == n:
            break
        n = m
    return e


def cycles(relations: DataFrame, depth: int | None = None) -> DataFrame:
    """(cycle array<string>): each simple cycle once, from its least node, of any length
    or of up to ``depth`` nodes. The search ends when no path can grow; the number of
    cycles of a dense graph is exponential, which ``depth`` is for."""
    moves = on_cycles(relations)
    front = moves.where("a <= b").select(F.col("a").alias("first"), F.col("b").alias("id"), F.array("a", "b").alias("path"))
    found = front.where("first = id").select(F.array("first").alias("cycle"))
    front = front.where("first < id")
    length = 1
    while depth is None or length < depth:
        length += 1
        new = cut(front.join(moves, F.col("id") == F.col("a")).where("b >= first"))
        if new.isEmpty():
            break
        found = found.unionByName(new.where("b = first").select(F.col("path").alias("cycle")))
        front = new.where(~F.array_contains("path", F.col("b"))).select("first", F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
    return found


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (source, type, target, scope); a new one replaces the old."""
    keys = ["source_id", "relation_type", "target_id", "scope"]
    both = old.withColumn("__p", F.lit(1)).unionByName(new.withColumn("__p", F.lit(0)))
    by = Window.partitionBy(*keys).orderBy("__p", F.desc("weight"))
    return both.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__p", "__n")


def without_edges(old: DataFrame, gone: DataFrame) -> DataFrame:
    """``old`` less the edges ``gone``, in their scopes (null is the unscoped one)."""
    keys = ["source_id", "relation_type", "target_id", "scope"]
    g = gone.select(*[F.col(k).alias(f"g_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"g_{k}"))
    return old.join(g, on, "left_anti")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the least node reached, from links (a, b)."""
    link = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(pairs.where("a <> b").select(link.alias("x")).select("x.*").distinct())
    last = None
    for _ in range(rounds):
        # all neighbours above a node, then all below it, move to the least one known
        ways = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = ways.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def mermaid(relations: DataFrame, limit: int = 200) -> DataFrame:
    """One row of graph text over at most ``limit`` edges, for people to read."""
    few = relations.orderBy("source_id", "relation_type", "target_id").limit(limit)
    line = F.concat(F.lit("  "), "source_id", F.lit(" -- "), "relation_type", F.lit(" --> "), "target_id")
    lines = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return few.agg(F.concat(F.lit("graph LR\n"), lines).alias("text"))


def dot(relations: DataFrame, limit: int = 200) -> DataFrame:
    few = relations.orderBy("source_id", "relation_type", "target_id").limit(limit)
    line = F.format_string('  "%s" -> "%s" [label="%s"];', "source_id", "target_id", "relation_type")
    return few.agg(F.concat(F.lit("digraph {\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n}")).alias("text"))
