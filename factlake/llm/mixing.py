"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share by weight, at most
``max_copies`` times its size, the excess reshared by weight. Inside a source a
document's expected copies grow with its own weight, by default the number of
binary digits of its size, so that long documents are repeated more often than
snippets: expected = min(max_copies, scale * weight), with the scale at which
the expected words equal the target. The whole part is taken for certain; the
rest, between 0 and 1, is the inclusion probability p in a sample of fixed size,
the words that are left. Documents are ranked by random odds over inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the source's
words are filled; one that would overshoot by more than it fills is passed over.

Rows of equal id, text and source are one class with a count; their k-th copy
has a random number of its own, so that no rank holds a large group and reruns
agree. Whether a row is taken follows from its own numbers and one row of its
source: only the rows of the rank step in which a source runs out are joined.

Edge cases: a null text has size 0; null sources are one source, the last;
null and repeated ids are told apart by text and count; size-0 documents are
never part of the sample; an empty table gives an empty table; other columns
are ignored, and ``repeat_documents`` returns them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.llm.common import ranked, small, staged, words_of

#: Documents that share one step of the ranking; only the step in which a
#: source's words run out is looked at row by row.
DOCS_PER_STEP = 2048
#: Rows of a class that are numbered at once.
CHUNK = 10_000
SEED = 20240917
KEY = ["doc_id", "skey", "size", "h"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """``target`` for each row of (skey, source, source_size, n_docs).

    Sources take the weights in order of their names, repeating. The loop
    over-fills no source: each pass fixes those above their ceiling and shares
    what remains, so it ends after at most one pass per source; each pass is an
    aggregation of one row.
    """
    order = [F.col("source").isNull(), F.col("source")]
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = ranked(sizes, order, "source_rank")
    t = t.withColumn("weight", F.element_at(table, (F.col("source_rank") % len(weights)).cast("int") + 1))
    t = staged(t.withColumn("ceiling", F.col("source_size") * max_copies), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    rate, n_full = 0.0, -1
    while total:
        full = F.col("ceiling") <= F.col("weight") * F.lit(rate)
        got = t.agg(
            F.count_if(full), F.sum(F.when(full, F.col("ceiling"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if got[0] == n_full or not got[2]:
            break
        n_full, rate = got[0], (total - (got[1] or 0)) / got[2]
    return t.withColumn("target", F.least(F.col("ceiling").cast("double"), F.col("weight") * F.lit(float(rate))))


def binary_digits(size: Column) -> Column:
    """The default weight of a document: 1 for one word, 10 for a thousand."""
    return F.length(F.bin(size)).cast("double")


def _keys(docs: DataFrame, seed: int, doc_weight: Column | None) -> DataFrame:
    """``docs`` with the key of each row (__doc_id, __skey, __size, __h) and its
    weight __w, to one decimal from 0.1 to 100."""
    source = F.col("source").cast("string")
    size = F.size(words_of(F.col("text"))).cast("long")
    weight = binary_digits(size) if doc_weight is None else F.coalesce(doc_weight.cast("double"), F.lit(1.0))
    return docs.withColumns(
        {
            "__doc_id": F.col("doc_id").cast("long"),
            "__skey": F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)),
            "__size": size,
            "__h": F.xxhash64("doc_id", "text", source, source.isNull(), F.lit(seed)),
            "__w": F.greatest(F.lit(0.1), F.least(F.lit(100.0), F.round(weight, 1))),
        }
    )


def _occurrences(classes: DataFrame) -> DataFrame:
    """``classes`` with a row for each of their ``m`` members, numbered by ``i``.

    Large classes are dealt in chunks, so that no task writes one whole.
    """
    each = lambda lo, hi: F.explode(F.sequence(lo, hi)).alias("i")
    names = [c for c in classes.columns if c != "m"]
    few = classes.where(F.col("m") <= CHUNK).select(*names, each(F.lit(0).cast("long"), F.col("m") - 1))
    many = classes.where(F.col("m") > CHUNK)
    if many.isEmpty():
        return few
    parts = many.select(*names, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long"))).alias("lo"))
    parts = parts.repartition("h", "lo")
    return few.unionByName(parts.select(*names, each(F.col("lo"), F.least(F.col("lo") + CHUNK, F.col("m")) - 1)))


def _scales(levels: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """(skey, scale): the factor of the weights at which the expected words equal the target.

    A source has at most 1,000 weights, so its window is small. From the
    heaviest down, those before a weight are full; the first weight that stays
    below the limit then fixes the scale.
    """
    rows = levels.where("words > 0").join(small(targets.select("skey", "target")), "skey")
    down = Window.partitionBy("skey").orderBy(F.desc("w"))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("scale", (F.col("target") - max_copies * full) / open_)
    fits = F.col("scale") * F.col("w") <= max_copies
    return rows.groupBy("skey").agg(
        F.coalesce(F.max_by(F.when(fits, F.col("scale")), F.when(fits, F.col("w"))), max_copies / F.min("w")).alias("scale")
    )


def _expected(max_copies: int) -> Column:
    return F.when(F.col("size") > 0, F.least(F.lit(float(max_copies)), F.coalesce("scale", F.lit(0.0)) * F.col("w"))).otherwise(0.0)


def _placed(rows: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """``rows`` (key, w, i) with whole copies, p and their place in the ranking of their source."""
    rows = rows.join(sources, "skey").withColumn("whole", F.floor(_expected(max_copies))).withColumn("p", _expected(max_copies) - F.floor(_expected(max_copies)))
    # 53 bits of a hash, moved off both ends of (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64("h", "i"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # odds / (1 + odds) has the same order and lies between 0 and 1
    rows = rows.withColumn("at", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds)))
    steps = F.ceil(F.col("n_docs") / DOCS_PER_STEP)
    return rows.withColumn("step", F.least(F.floor(F.col("at") * steps), steps - 1))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Take documents of one step in rank order while they bring the words nearer."""
    rows = rows.sort_values(["at", "h", "i"], kind="stable")
    left, extra = float(rows["left"].iloc[0]), []
    for size in rows["size"]:
        fits = size / 2 <= left
        extra.append(int(fits))
        left -= size if fits else 0
    return rows.assign(extra=extra)[["skey", "h", "i", "extra"]]


class Plan:
    """What decides about every row: ``classes`` (key, w, m), ``sources`` (skey,
    source, source_size, target, n_docs, scale, last) and ``edge`` (skey, h, i,
    extra) for the rows of each source's last step."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...], max_copies: int, seed: int, doc_weight: Column | None) -> None:
        self.max_copies = max_copies
        keyed = _keys(docs, seed, doc_weight).select(*[F.col(f"__{c}").alias(c) for c in (*KEY, "w")])
        self.classes = staged(keyed.groupBy(*KEY, "w").agg(F.count("*").alias("m")), "mix")
        levels = self.classes.groupBy("skey", "w").agg(F.sum(F.col("m") * F.col("size")).alias("words"), F.sum("m").alias("n"))
        levels = staged(levels, "mix-levels")
        sizes = levels.groupBy("skey").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
        source = F.when(F.col("skey") != "n", F.substring("skey", 2, 2**31 - 1))
        targets = source_targets(sizes.withColumn("source", source), weights, max_copies)
        targets = staged(targets.select("skey", "source", "source_size", "target", "n_docs"), "mix-targets")
        sources = targets.join(_scales(levels, targets, max_copies), "skey", "left")
        sources = staged(sources, "mix-scales")

        drawn = _placed(_occurrences(self.classes), small(sources), max_copies)
        sums = drawn.groupBy("skey", "step").agg(
            F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum("size").alias("words"), F.first("target").alias("target")
        )
        of_source = Window.partitionBy("skey")
        sums = staged(sums, "mix-steps").withColumn("rest", F.col("target") - F.sum("certain").over(of_source)).where("step IS NOT NULL")
        upto = of_source.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        last = (
            sums.where("upto > rest").groupBy("skey")
            .agg(F.min(F.struct("step", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left"))).alias("x"))
            .select("skey", F.col("x.step").alias("last"), F.col("x.left").alias("left"))
        )
        self.sources = staged(sources.join(last, "skey", "left"), "mix-sources")
        edge = _placed(_occurrences(self.classes), small(self.sources), max_copies).where("step = last")
        edge = edge.select("skey", "h", "i", "size", "at", "left")
        self.edge = staged(edge.groupBy("skey").applyInPandas(_fill, "skey string, h long, i long, extra int"), "mix-edge")

    def decided(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, w, i and others) with their source's columns, p and copies."""
        placed = _placed(rows, small(self.sources), self.max_copies)
        at_last = F.coalesce(F.col("step") == F.col("last"), F.lit(False))
        sure = F.col("step").isNotNull() & (F.col("last").isNull() | (F.col("step") < F.col("last")))
        # few rows meet the table of the last steps; all others are decided where they are
        plain = placed.where(~at_last).withColumn("extra", sure.cast("int"))
        edge = placed.where(at_last).join(small(self.edge), ["skey", "h", "i"])
        both = plain.unionByName(edge.select(*plain.columns))
        return both.withColumn("copies", (F.col("whole") + F.col("extra")).cast("long"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_copies: int = 3,
    seed: int = SEED,
    doc_weight: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies,
    taken (copies * size), inclusion (its probability of one more copy)."""
    plan = Plan(docs, weights, max_copies, seed, doc_weight)
    return plan.decided(_occurrences(plan.classes)).select(
        "doc_id", "size", "source", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), F.col("p").alias("inclusion"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``i``, from 0 in each class: counts by partition, then places in it."""
    rows = staged(rows.withColumn("__n", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "repeated")
    h = F.col("__h")
    by = Window.partitionBy("h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(h.alias("h"), "__part").count()
    before = counts.select("h", "__part", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("__before"))
    here = Window.partitionBy(h, "__part").orderBy("__n")
    rows = rows.withColumn("__at", F.row_number().over(here) - 1)
    rows = rows.join(small(before.withColumnRenamed("__part", "__p")), (h == F.col("h")) & (F.col("__part") == F.col("__p")))
    return rows.withColumn("__i", (F.col("__at") + F.col("__before")).cast("long")).drop("h", "__p", "__part", "__n", "__at", "__before")


def repeat_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_copies: int = 3,
    seed: int = SEED,
    doc_weight: Column | None = None,
) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it.

    Texts stay where they are, but for those of repeated rows and of the last steps.
    """
    plan = Plan(docs, weights, max_copies, seed, doc_weight)
    keyed = _keys(docs, seed, doc_weight)
    twice = staged(plan.classes.where("m > 1").select(F.col("h").alias("__h")).distinct(), "mix-twice")
    rows = keyed.withColumn("__i", F.lit(0).cast("long"))
    if not twice.isEmpty():
        again = small(twice)
        rows = rows.join(again, "__h", "left_anti").unionByName(_numbered(keyed.join(again, "__h", "left_semi")))
    own = [F.col(c).alias(f"__own_{c}") for c in docs.columns]
    out = plan.decided(rows.select(*own, *[F.col(f"__{c}").alias(c) for c in ("i", "skey", "size", "h", "w")]))
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    out = out.where("copies > 0 AND size > 0").select(*[f"__own_{c}" for c in docs.columns], again)
    return out.select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])
