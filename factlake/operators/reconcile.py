"""Two replicas made equal by comparing digests of ranges.

A row falls into a leaf by the leading bits of a hash of its key. The digest of a leaf is
the number of its rows and the sum of their hashes, so it depends on no order; that of a
node above is the sum over its children. Both sides build their tree once, in one pass
that shuffles a row for each leaf and task, and keep it as a small table. Then nodes are
compared level by level, children only of nodes that differ, and only rows of leaves that
differ are read and sent. What passes between the sides follows from what differs.

Sums of 64-bit hashes find accidental differences, not ones made on purpose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.staging import small, staged

#: Bits from one level to the next: a node has 16 children.
STEP = 4
#: Rows of a leaf that a tree aims at.
LEAF = 1024


@dataclass(frozen=True)
class Difference:
    """``rows`` of both sides (``here`` says which) in leaves that differ; how many nodes were compared in how many rounds."""

    rows: DataFrame
    nodes: int
    rounds: int


def depth_for(n: int) -> int:
    """Bits of a leaf's name for ``n`` rows, in whole levels; both sides must use the same."""
    depth = 0
    while n > LEAF << depth and depth < 40:
        depth += STEP
    return depth


def _leaf(keys: list[str], depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - depth) if depth else F.lit(0).cast("long")


def _hash(columns: list[str]) -> Column:
    """A hash of all columns in which a null counts by its place."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]).cast("decimal(20,0)")


def leaves(table: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(level, node, n, digest) of the lowest level: one row for each leaf that has rows."""
    rows = table.select(_leaf(keys, depth).alias("node"), _hash(sorted(table.columns)).alias("h"))
    # the sum wraps into 38 digits only beyond 10^18 rows of a node
    return rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("h").cast("decimal(38,0)").alias("digest")).select(F.lit(depth).alias("level"), "node", "n", "digest")


def tree(table: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """All levels of a table's tree, stored: its size is that of the leaves and a fifteenth more."""
    level = staged(leaves(table, keys, depth), "leaves")
    out = level
    for up in range(depth - STEP, -1, -STEP):
        above = F.shiftrightunsigned("node", STEP)
        level = level.groupBy(above.alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest")).select(F.lit(up).alias("level"), "node", "n", "digest")
        out = out.unionByName(level)
    return staged(out.repartitionByRange("level", "node").sortWithinPartitions("level", "node"), "digest-tree")


def difference(here: DataFrame, there: DataFrame, keys: list[str], depth: int, trees: tuple[DataFrame, DataFrame] | None = None) -> Difference:
    """What must pass between two tables. Stored ``trees`` save the pass over the rows."""
    mine, theirs = trees or (tree(here, keys, depth), tree(there, keys, depth))
    wanted, nodes, rounds = None, 0, 0
    for level in range(0, depth + 1, STEP):
        a, b = (t.where(F.col("level") == level).drop("level") for t in (mine, theirs))
        if wanted is not None:
            a, b = (t.withColumn("up", F.shiftrightunsigned("node", STEP)).join(small(wanted), "up", "left_semi").drop("up") for t in (a, b))
        b = b.select("node", F.col("n").alias("n2"), F.col("digest").alias("digest2"))
        compared = staged(a.join(b, "node", "full_outer").select("node", (F.col("n").eqNullSafe(F.col("n2")) & F.col("digest").eqNullSafe(F.col("digest2"))).alias("same")), "compared")
        nodes, rounds = nodes + compared.count(), rounds + 1
        wanted = compared.where("NOT same").select(F.col("node").alias("up"))
        if wanted.isEmpty():
            break
    mark = lambda df, side: df.withColumn("here", F.lit(side)).withColumn("up", _leaf(keys, depth))
    both = mark(here, True).unionByName(mark(there, False)).join(small(wanted), "up", "left_semi").drop("up")
    return Difference(both, nodes, rounds)


def to_send(found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that one side has and the other has not, or has otherwise; equal ones of a differing leaf stay."""
    columns = [c for c in found.columns if c != "here"]
    sides = found.withColumn("__h", _hash(sorted(columns))).groupBy(*keys, "__h").agg(F.count_distinct("here").alias("__sides"))
    same = sides.where("__sides = 2").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__h").alias("__same"))
    on = F.col("__h") == F.col("__same")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.withColumn("__h", _hash(sorted(columns))).join(same, on, "left_anti").drop("__h")


def reconcile(here: DataFrame, there: DataFrame, keys: list[str], order: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(rows that ``here`` must write, rows that ``there`` must write): of a key the row with the later ``order`` wins.

    Equal times go by the hash of the row, so that both sides choose alike. A row that a
    side deleted must stay as a tombstone, or the other side gives it back.
    """
    rows = staged(to_send(difference(here, there, keys, depth).rows, keys), "to-send")
    columns = here.columns
    rank = F.struct(F.col(order).isNotNull().alias("x"), F.col(order).alias("a"), _hash(sorted(columns)).alias("h"), F.struct(*columns, "here").alias("row"))
    best = rows.groupBy(*keys).agg(F.max(rank).alias("best")).select("best.row.*")
    best = staged(best, "winners")
    return best.where("NOT here").drop("here"), best.where("here").drop("here")
