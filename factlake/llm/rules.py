"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed text statistics decide the base verdict. On top, every rule "reject if
statistic > cutoff" has a fixed list of cutoffs, lenient to strict. Together they
form one path of settings: each step makes one rule a cutoff stricter, all rules
in turn, so rejections only grow along it. A document's ``step`` is the first
that rejects it, and a setting is one number, the last step in force.

Labelled good documents of a stratum (its language) are the holdout: a setting
is safe if the exact binomial probability of seeing so few rejected good
documents, were the true false-rejection rate ``RISK``, is at most the level.
Settings are tested in the order of the path up to the first that is not safe
(fixed-sequence testing), which needs no correction among rules and cutoffs;
across strata the level is divided by their number (Bonferroni). So with
probability 1 - LEVEL the rules together reject at most RISK of the good
documents of every stratum. A stratum with too few labels (under about 230 with
five strata) gets no setting, and its documents only the base verdict.

Edge cases: null and empty texts have zero words and fail the base rule; a null
language is a stratum of its own; without labels only the base rules act;
repeated rows get equal verdicts; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.llm.common import let, small, staged, words_of

RISK, LEVEL = 0.02, 0.05
#: Cutoffs of each rule, lenient to strict.
CUTOFFS = {
    "symbol_ratio": (0.4, 0.3, 0.2, 0.1, 0.06),
    "upper_ratio": (0.8, 0.6, 0.5, 0.4),
    "dup_line_ratio": (0.9, 0.7, 0.6, 0.5),
    "repeat_ratio": (0.9, 0.7, 0.5, 0.4),
    "mean_word_length": (14.0, 12.0, 10.0, 9.0),
}


def _repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""

    def covered(places: Column) -> Column:
        # places of repeated windows, ascending: each adds 3 words, less overlap
        after = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(2**31 - 1)))
        return F.aggregate(F.zip_with(places, after, lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda s, x: s + x)

    def places(hashes: Column) -> Column:
        """Places of windows whose hash occurs again, ascending.

        Hash and place share one long, the place in its low bits, so that
        equal hashes sort together; neighbours are then compared in full.
        """
        n = F.size(hashes)
        mask = F.when(n < 2**10, F.lit(2**10 - 1)).when(n < 2**15, F.lit(2**15 - 1)).otherwise(F.lit(2**20 - 1))

        def again(p: Column, low: Column) -> Column:
            at = lambda x: F.get(hashes, x.bitwiseAND(low).cast("int"))
            # a neighbour beyond the ends is null and equals nothing
            hit = F.filter(p, lambda x, i: (at(x) == at(F.get(p, i + 1))) | (at(x) == at(F.get(p, i - 1))))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(low).cast("int")))

        def mingled(p: Column, low: Column) -> Column:
            """Whether two different hashes agree in their high bits; neighbours may then hide a repeat."""
            high = lambda x: x.bitwiseAND(F.bitwise_not(low))
            at = lambda x: F.get(hashes, x.bitwiseAND(low).cast("int"))
            return F.size(F.filter(p, lambda x, i: (high(x) == high(F.get(p, i + 1))) & (at(x) != at(F.get(p, i + 1))))) > 0

        def pack(low: Column) -> Column:
            mixed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
            return let(F.sort_array(mixed), lambda p: F.when(mingled(p, low), places_long(hashes)).otherwise(again(p, low)))

        return let(mask.cast("long"), pack)

    def places_long(hashes: Column) -> Column:
        """The same for texts of over 2**20 words, by sorting pairs."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            hit = F.filter(p, lambda x, i: (x["h"] == F.get(p, i + 1)["h"]) | (x["h"] == F.get(p, i - 1)["h"]))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        return let(pairs, again)

    def repeated(hashes: Column) -> Column:
        found = F.when(F.size(hashes) < 2**20, places(hashes)).otherwise(places_long(hashes))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(found, covered))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, let(hashes, repeated)).otherwise(0)

    return windows(words).cast("long")


def statistic() -> Column:
    """All statistics of the column ``text``, as one struct."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    return let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (2 * F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]{2}"))).cast("long").alias("n_upper"),
            let(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("long").alias("n_lines"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                ),
            ).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, ``__s``)."""
    return docs.select("doc_id", "lang", statistic().alias("__s"))


def measures(s: Column) -> dict[str, Column]:
    """The statistic of each rule, from a row of ``statistics``."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": ratio(s["n_symbols"], s["word_chars"]),
        "upper_ratio": ratio(s["n_upper"], s["word_chars"]),
        "dup_line_ratio": ratio(s["lines"]["n_dup_lines"], s["lines"]["n_lines"]),
        "repeat_ratio": ratio(s["n_repeat_words"], s["n_words"]),
        "mean_word_length": ratio(s["word_chars"], s["n_words"]),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 8 and a product back down."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return series - reduce(lambda a, b: a + b, [F.log(n.cast("double") + i) for i in range(1, 9)])


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), k <= n.

    Terms are summed downwards from k, each relative to the first; those more
    than 60 + 40 standard deviations below it vanish in double precision.
    """
    first = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    )
    odds = (1 - rate) / rate
    reach = F.least(k, F.ceil(60 + 40 * F.sqrt(n * rate))).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(0), reach),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct(
            (a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term")
        ),
    )
    # above the mean the terms below k are larger than the first; the tail is then over 1/2 in any case
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.exp(first) * step["sum"])


def stratum(lang: Column) -> Column:
    return F.when(lang.isNull(), "n").otherwise(F.concat(F.lit("s"), lang.cast("string")))


def path() -> list[tuple[str, float]]:
    """The steps from lenient to strict: the next cutoff of each rule in turn."""
    longest = max(map(len, CUTOFFS.values()))
    return [(rule, cuts[i]) for i in range(longest) for rule, cuts in CUTOFFS.items() if i < len(cuts)]


def step_of(s: Column) -> Column:
    """The first step of the path that rejects a document, from 1; null if none does."""
    values = measures(s)
    return F.coalesce(*[F.when(values[rule] > cut, F.lit(i)) for i, (rule, cut) in enumerate(path(), 1)])


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, n, last): the holdouts and the last safe step of each stratum, null if there is none.

    ``stats`` holds doc_id, lang and ``__s``; labels hold doc_id and quality.
    """
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    # documents that fail the base rules are rejected whatever the setting is
    hold = stats.where(~base_failed(F.col("__s"))).select("doc_id", stratum(F.col("lang")).alias("stratum"), step_of(F.col("__s")).alias("step"))
    hold = hold.join(good, "doc_id", "left_semi")
    # a row per stratum and step
    counts = hold.groupBy("stratum", "step").agg(F.count("*").alias("k"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(path())))).alias("last")
    of = counts.groupBy("stratum").agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "k")))).alias("at"))
    rows = of.select("stratum", "n", "at", steps).withColumn("k", F.coalesce(F.try_element_at("at", F.col("last")), F.lit(0)))
    upto = Window.partitionBy("stratum").orderBy("last")
    rows = rows.withColumn("rejected", F.sum("k").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    n_strata = F.size(F.collect_set("stratum").over(Window.partitionBy(F.lit(1))))
    rows = rows.withColumn("p", binomial_tail(F.col("rejected"), F.col("n"), risk)).withColumn("level", F.lit(level) / n_strata)
    # rejections only grow along the path, so the last safe step comes before the first unsafe one
    safe = F.max(F.when(F.col("p") <= F.col("level"), F.col("last"))).alias("last")
    return staged(rows.groupBy("stratum").agg(F.first("n").alias("n"), safe), "cutoffs")


def with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``rows`` with ``__last``, the last step in force in their stratum, or null.

    There is a row per language; they are broadcast while they are few.
    """
    cuts = small(cutoffs.select(F.col("stratum").alias("__stratum"), F.col("last").alias("__last")))
    return rows.join(cuts, stratum(F.col("lang")) == F.col("__stratum"), "left")


def passes(s: Column, last: Column) -> Column:
    """Whether no rule of the method rejects a document."""
    return ~F.coalesce(step_of(s) <= last, F.lit(False))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed and kept of every document."""
    stats = staged(statistics(docs), "rules")
    out = with_cutoffs(stats, calibrate(stats, labels))
    failed = base_failed(F.col("__s"))
    return out.select(
        "doc_id", "__s.n_words", "__s.word_chars", "__s.n_symbols", "__s.lines.n_dup_lines", "__s.n_repeat_words",
        failed.alias("base_failed"), (~failed & passes(F.col("__s"), F.col("__last"))).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Statistics come first, as narrow rows; the second pass computes them again
    and filters row by row, so that no text is shuffled. Null and empty texts fail
    the base rules and go; null and repeated ids are judged row by row; without
    labels only the base rules act; an empty table stays empty.
    """
    stats = docs.select("doc_id", "lang", statistic().alias("__s"))
    cutoffs = calibrate(staged(stats, "rules"), labels)
    # one expression, so that the filter computes the statistics once per row
    keep = let(statistic(), lambda s: ~base_failed(s) & passes(s, F.col("__last")))
    return with_cutoffs(docs, cutoffs).where(keep).select(*docs.columns)


def oracle() -> str:
    """The same in SQL, with tails of the binomial distribution from log-gammas."""
    over = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0 END"
    values = {
        "symbol_ratio": over("n_symbols", "word_chars"), "upper_ratio": over("n_upper", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"), "repeat_ratio": over("n_repeat_words", "n_words"),
        "mean_word_length": over("word_chars", "n_words"),
    }
    steps = " ".join(f"WHEN {values[rule]} > {cut} THEN {i}" for i, (rule, cut) in enumerate(path(), 1))
    return f"""
WITH rows AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT k, doc_id, lang, t, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM rows),
places AS (SELECT k, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM split WHERE len(w) >= 3),
grams AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
twice AS (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT k, count(DISTINCT p) AS n FROM twice GROUP BY 1),
stats AS (SELECT k, doc_id, coalesce('s' || lang, 'n') AS stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    2 * len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]{{2}}')) AS n_upper, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN repeats USING (k)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE {steps} END AS step FROM stats),
hold AS (SELECT stratum, step FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS (SELECT stratum, last, count(*) AS n, count(*) FILTER (step <= last) AS rejected FROM hold, (SELECT unnest(range(1, {len(path()) + 1})) AS last) GROUP BY 1, 2),
tails AS (SELECT stratum, last, list_sum(list_transform(range(0, rejected + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) AS p FROM tests),
safe AS (SELECT stratum, max(last) AS last FROM tails WHERE p <= {LEVEL} / (SELECT count(DISTINCT stratum) FROM hold) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(NOT step <= last, true) AS kept FROM judged LEFT JOIN safe USING (stratum)"""
