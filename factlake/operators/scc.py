"""Strongly connected components, by trimming and forward-backward colouring.

A round works on all components that are still open at the same time:

1. Nodes without a way in or without a way out, inside what is left, are
   components of their own; they go, repeatedly, until none is left.
2. Every node gets the largest id that reaches it, its colour, by passing
   maxima along the edges until nothing changes.
3. A node whose colour is its own id is a root. Going back along the edges inside
   a colour, all nodes that reach the root are its component; they go as well.

Edges between colours cannot lie on a cycle and are dropped for the next round.
Each step is a join and an aggregate over the edges that are left, checkpointed;
a hub's edges are one key of a join that adaptive execution splits, and maxima
are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.graph import steps
from factlake.staging import cut


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that remain when nodes without a way in or out are dropped, repeatedly."""
    n = edges.count()
    while n:
        heads, tails = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = cut(edges.join(heads, "a", "left_semi").join(tails, "b", "left_semi").select("a", "b"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, colour): the largest id that reaches each node of the edges."""
    colour = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("colour", F.col("id")))
    moved = colour
    while not moved.isEmpty():
        # only nodes whose colour has just changed pass it on
        sent = edges.join(moved, F.col("a") == F.col("id")).groupBy("b").agg(F.max("colour").alias("got"))
        both = colour.join(sent, F.col("id") == F.col("b"), "left")
        both = cut(both.select("id", F.greatest("colour", "got").alias("colour"), F.coalesce(F.col("got") > F.col("colour"), F.lit(False)).alias("moved")))
        colour, moved = both.select("id", "colour"), both.where("moved").select("id", "colour")
    return colour


def _members(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(id, colour) of the nodes that reach the root of their colour inside it."""
    known = cut(colour.where("id = colour"))
    front = known
    while True:
        back = edges.join(front, (F.col("b") == F.col("id")) & (F.col("colour") == F.col("c"))).select(F.col("a").alias("id"), "colour").distinct()
        front = cut(back.join(known.select("id"), "id", "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def strong_components(relations: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(id, component, size) of every node on a cycle of the relations (source_id, relation_type,
    target_id): the least id of its component, and how many nodes that has. A node with an edge
    to itself is a component of one; nodes on no cycle are left out."""
    moves = cut(steps(relations, "forward", types).select("a", "b").distinct())
    loops = moves.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    edges = _trimmed(cut(moves.where("a <> b")))
    found = loops
    while not edges.isEmpty():
        colour = _coloured(edges)
        of = lambda c, name: colour.select(F.col("id").alias(c), F.col("colour").alias(name))
        # edges inside a colour, with it; no cycle leaves one
        inside = cut(edges.join(of("a", "c"), "a").join(of("b", "d"), "b").where("c = d").select("a", "b", "c"))
        members = _members(inside, colour)
        found = found.unionByName(members.select("id", F.col("colour").alias("component")))
        rest = inside.join(members.select(F.col("id").alias("a")), "a", "left_anti").join(members.select(F.col("id").alias("b")), "b", "left_anti")
        edges = _trimmed(cut(rest.select("a", "b")))
    # a loop's node that lies on a longer cycle belongs to that; a root alone is on none
    sizes = found.groupBy("component").agg(F.min("id").alias("least"), F.count_distinct("id").alias("size"))
    rows = found.join(sizes, "component").join(loops.select("id", F.lit(True).alias("loop")), "id", "left").where("size > 1 OR loop")
    return rows.groupBy("id").agg(F.max(F.struct("size", "least")).alias("x")).select("id", F.col("x.least").alias("component"), F.col("x.size").alias("size"))


def condensed(relations: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(a, b): the edges between components, named by their least id; nodes on no cycle stand for themselves. It has no cycle."""
    moves = steps(relations, "forward", types).select("a", "b").distinct()
    part = strong_components(relations, types).select("id", "component")
    of = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"__{c}"))
    both = moves.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b")).where("a <> b").distinct()
