"""Quality checks of a store: orphans, duplicates, stale entities, conflicts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.staging import small, staged

#: Pairs of names up to which keys of one, two, three and four trigrams do; and keys made at a time.
PAIRS, KEYS = (10**6, 10**8, 10**10, 10**11), 500_000

#: Severity of each check and what to do about it.
SEVERITY = {"orphan": "warning", "duplicate": "warning", "stale": "info", "conflict": "warning"}
ACTION = {
    "orphan": "link the entity or delete it", "duplicate": "merge the two entities",
    "stale": "review and touch, or archive", "conflict": "supersede all but one",
}


def orphans(entities: DataFrame, relations: DataFrame, bridge: DataFrame) -> DataFrame:
    """Entities without an edge and without a fact."""
    used = (
        relations.select(F.col("source_id").alias("id"))
        .union(relations.select(F.col("target_id")))
        .union(bridge.select(F.col("entity_id")))
        .distinct()
    )
    return entities.join(used, "id", "left_anti")


def trigrams(name: Column) -> Column:
    """Distinct windows of three characters, with two blanks on either side."""
    padded = F.concat(F.lit("  "), F.lower(name), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def _least_overlap(n: int, m: int, least_shared: int, similarity: float) -> int:
    """How many trigrams sets of ``n`` and ``m`` share at least if their similarity is above the bound."""
    s = least_shared
    while s <= min(n, m) and not s / (n + m - s) > similarity:
        s += 1
    return s


def _plans(sizes: dict[str, dict[int, int]], least_shared: int, ratio: float, similarity: float) -> dict[tuple[str, int], list[tuple[int, int, bool, bool, int, int]]]:
    """By type and size of a set: (smaller size, larger size, as the smaller, as the larger, prefix, trigrams of a key)
    for each size that a partner may have."""
    out: dict[tuple[str, int], list] = {}
    for kind, counts in sizes.items():
        for n in counts:
            for m in counts:
                low, high = min(n, m), max(n, m)
                share = _least_overlap(low, high, least_shared, similarity)
                if low < ratio * high or share > low:
                    continue
                pairs = counts[n] * counts[m]
                key = min(share, next((k for k, most in enumerate(PAIRS, 1) if pairs <= most), len(PAIRS) + 1))
                out.setdefault((kind, n), []).append((low, high, n == low, n == high, n - share + key, key))
    return out


def duplicates(entities: DataFrame, least_shared: int = 4, ratio: float = 0.9, similarity: float = 0.9) -> DataFrame:
    """Pairs of near-identical names of one type.

    Equal names are one row of the join, with the smallest id of each. Names meet by
    prefix filters: of two sets that share s trigrams at least, the k rarest shared ones
    are among the n - s + k rarest of either, so a key is k trigrams of such a prefix. The
    more names two sizes have, the more trigrams are in a key, up to five, so that names of which
    most trigrams are common do not all meet. Sizes of partners, and s with them, follow
    from the bounds; every met pair is compared whole.
    """
    names = entities.groupBy("entity_type", F.lower("name").alias("low")).agg(F.min("id").alias("id"), F.min("name").alias("name"))
    names = names.where("entity_type IS NOT NULL AND low IS NOT NULL").withColumn("g", trigrams(F.col("low")))
    names = staged(names.withColumns({"n": F.size("g"), "k": F.monotonically_increasing_id()}), "names")
    sizes: dict[str, dict[int, int]] = {}
    # a row for each type and size of a set
    for r in names.groupBy("entity_type", "n").count().collect():
        sizes.setdefault(r["entity_type"], {})[r["n"]] = r["count"]
    plans = _plans(sizes, least_shared, ratio, similarity)
    grams = names.select("entity_type", "k", F.explode("g").alias("t"))
    df = grams.groupBy("entity_type", "t").agg(F.count("*").alias("df"))
    ordered = grams.join(small(df), ["entity_type", "t"]).groupBy("entity_type", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("ordered"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ks = b.column(0).to_pylist(), b.column(1).to_numpy()
            counts = pc.list_value_length(b.column(2)).to_numpy()
            first = np.cumsum(counts) - counts
            marks = pd.util.hash_array(b.column(2).flatten().to_numpy(zero_copy_only=False).astype(object), categorize=True)
            groups: dict[tuple[str, int], list[int]] = {}
            for i, group in enumerate(zip(kinds, counts.tolist(), strict=True)):
                groups.setdefault(group, []).append(i)
            for group, mine in groups.items():
                of_kind = pd.util.hash_array(np.array([group[0]], dtype=object))[0]
                for low, high, as_low, as_high, prefix, size in plans.get(group, ()):
                    combos = np.array(list(itertools.combinations(range(prefix), size)))
                    step = max(1, KEYS // len(combos))
                    for j in range(0, len(mine), step):
                        rows = np.array(mine[j : j + step])
                        held = marks[first[rows][:, None] + np.arange(prefix)]
                        key = np.zeros((len(rows), len(combos)), dtype=np.uint64)
                        for c in range(size):  # a mix that depends on the order, which is that of rarity on either side
                            key = (key ^ held[:, combos[:, c]]) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                        key ^= of_kind + np.uint64(low * 1_000_003 + high)
                        side = (1 if as_low else 0) + (2 if as_high else 0)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ks[rows], len(combos))), pa.array(np.full(key.size, side, dtype=np.int8))], names=["key", "k", "side"])

    keys = staged(ordered.mapInArrow(keyed, "key long, k long, side byte"), "keys")
    # keys that one name has alone never make a pair
    a, b = keys.where("side IN (1, 3)"), keys.where("side IN (2, 3)")
    met = a.select("key", F.col("k").alias("a"), F.col("side").alias("s")).join(b.select("key", F.col("k").alias("b")), "key").where("s = 1 OR a < b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda side: names.select(F.col("k").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "name", "entity_type", "g", "n")])
    # keys are hashes, so pairs are compared by what they are: type, sizes and trigrams
    pairs = met.join(of("a"), "a").join(of("b"), "b").where((F.col("a_entity_type") == F.col("b_entity_type")) & (F.least("a_n", "b_n") >= ratio * F.greatest("a_n", "b_n")))
    shared = F.size(F.array_intersect("a_g", "b_g"))
    score = shared / (F.col("a_n") + F.col("b_n") - shared)
    pairs = pairs.where((shared >= least_shared) & (score > similarity)).withColumn("similarity", score)
    swap = F.col("a_id") > F.col("b_id")
    either = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return pairs.select(either("a_id", "b_id", "a_id"), either("b_id", "a_id", "b_id"), either("a_name", "b_name", "a_name"), either("b_name", "a_name", "b_name"), "similarity").where("a_id < b_id").distinct()


def stale(entities: DataFrame, now: int, max_age: int) -> DataFrame:
    return entities.where(F.col("updated_at") < now - max_age)


def conflicts(facts: DataFrame, types: list[str]) -> DataFrame:
    """(entity, fact_type, n, first_ids): entities with two or more current facts of one
    ruling type, and the first three of them."""
    current = facts.where(F.col("superseded_at").isNull() & F.col("fact_type").isin(types))
    by = Window.partitionBy("entity", "fact_type").orderBy("id")
    # a window that stops at three rows, so that no group is gathered whole
    few = current.select("entity", "fact_type", "id").withColumn("pos", F.row_number().over(by)).where("pos <= 3")
    first = few.groupBy("entity", "fact_type").agg(F.sort_array(F.collect_list("id")).alias("first_ids"))
    groups = current.groupBy("entity", "fact_type").agg(F.count("*").alias("n")).where("n >= 2")
    return groups.join(first, ["entity", "fact_type"])


def rollup(issues: DataFrame) -> DataFrame:
    """Issues per code."""
    return issues.groupBy("code").agg(F.count("*").alias("n"))


def report(entities: DataFrame, relations: DataFrame, bridge: DataFrame, facts: DataFrame, now: int, types: list[str]) -> DataFrame:
    """All four checks as (code, severity, subject, action)."""
    parts = {
        "orphan": orphans(entities, relations, bridge).select("id"),
        "duplicate": duplicates(entities).select(F.col("a_id").alias("id")),
        "stale": stale(entities, now, 90 * 86_400_000).select("id"),
        "conflict": conflicts(facts, types).select(F.col("entity").alias("id")),
    }
    out = None
    for code, rows in parts.items():
        rows = rows.select(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), F.col("id").alias("subject"), F.lit(ACTION[code]).alias("action"))
        out = rows if out is None else out.unionByName(rows)
    return out
