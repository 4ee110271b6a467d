"""Lexical, vector and hybrid ranking.

Filters come before ranks; corpus statistics come from the whole corpus. Ranks
are numbered only inside a leg that a limit has already cut, so the window over
it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators.filters import prefer
from factlake.staging import small, staged

K1, B, RRF_K = 1.2, 0.75, 60
#: Blocks of Hangul, kana and Han.
CJK = r"[ᄀ-ᇿ぀-ヿ㄰-㆏㐀-䶿一-鿿ꥠ-꥿가-힯豈-﫿]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    """Unique terms of a query, in order; the same rule as ``tokens``."""
    out, run = [], ""
    for c in query.lower() + " ":
        if c.isalnum():
            run += c
        elif run:
            out, run = out + [run], ""
    return list(dict.fromkeys(out))


def _saturated(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


#: Order of hits of equal score, as far as their table has the columns.
TIES = ["content", "source", "source_id", "fact_type", "entity_names", "observed_at", "id"]


def term_counts(low: Column, terms: list[str]) -> list[Column]:
    """How often each term stands in a lower-cased text; a plain search comes first, as most texts lack most terms."""
    whole = lambda t: rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])"
    return [F.when(low.contains(t), F.regexp_count(low, F.lit(whole(t)))).otherwise(0) for t in terms]


def term_rows(docs: DataFrame, terms: list[str], text: str = "content") -> DataFrame:
    """``docs`` with __len, the number of tokens, and __tf0.. of the terms."""
    low = F.lower(F.col(text))
    counts = {f"__tf{i}": c for i, c in enumerate(term_counts(low, terms))}
    return docs.withColumns({"__len": F.coalesce(F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")), F.lit(0)), **counts})


def bm25_scored(docs: DataFrame, query: str, text: str = "content", where: Column | None = None, avgdl: float | None = None) -> DataFrame:
    """(id, score) of the documents that hold a term, in one pass over the texts.

    The pass observes the corpus statistics while it writes the narrow counts of
    the hits; no text is written or shuffled. ``where`` filters hits, not statistics.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    rows = term_rows(docs, terms, text)
    seen, names = Observation(), [f"__tf{i}" for i in range(len(terms))]
    found = [F.count_if(F.col(c) > 0).alias(f"df{i}") for i, c in enumerate(names)]
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("__len").alias("avg"), *found)
    some = F.greatest(*names, F.lit(0)) > 0
    hits = staged(rows.where(some if where is None else some & where).select("id", "__len", *names), "hits")
    stats = seen.get
    average, score = F.lit(float(avgdl or stats["avg"] or 1.0)), F.lit(0.0)
    for i, c in enumerate(names):
        df = stats[f"df{i}"]
        score = score + F.log1p(F.lit((stats["n"] - df + 0.5) / (df + 0.5))) * _saturated(F.col(c), F.col("__len"), average)
    return hits.select("id", score.alias("score"))


def bm25(docs: DataFrame, query: str, limit: int, text: str = "content", where: Column | None = None, avgdl: float | None = None) -> DataFrame:
    """The best ``limit`` documents with score (to six digits) and rank; ties go by ``TIES``.

    Only documents that reach the last score are fetched whole.
    """
    scored = bm25_scored(docs, query, text, where, avgdl).withColumn("score", F.round("score", 6))
    last = scored.orderBy(F.desc("score")).limit(limit).agg(F.min("score")).first()[0]
    reach = small(scored.where(F.col("score") >= F.lit(last)))
    ties = [F.asc_nulls_last(c) for c in TIES if c in docs.columns]
    return top(docs.join(reach, "id"), [F.desc("score"), *ties], limit)


def bm25_many(docs: DataFrame, queries: DataFrame, limit: int, text: str = "content", same: str | None = None, but_own: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the best ``limit`` documents of each query.

    ``queries`` has query_id and query. Terms of all queries restrict the
    exploded tokens by a join, so unrelated tokens are dropped at once, and
    tokens are counted inside their text. ``same`` names a column of both that
    must be equal, ``but_own`` leaves out the document with the query's id.
    """
    keys = [] if same is None else [same]
    wanted = queries.select("query_id", *[F.col(c).alias("__same") for c in keys], F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    words = docs.select("id", *keys, tokens(F.coalesce(F.col(text), F.lit(""))).alias("__tokens")).withColumn("__len", F.size("__tokens"))
    corpus = words.agg(F.count("*").alias("n"), F.avg("__len").alias("avg"))
    tf = (
        words.select("id", *keys, "__len", F.explode("__tokens").alias("term"))
        .join(small(wanted.select("term").distinct()), "term", "left_semi")
        .groupBy("id", *keys, "__len", "term")
        .agg(F.count("*").alias("tf"))
    )
    tf = staged(tf, "term-counts")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    one = F.broadcast(corpus.withColumn("__one", F.lit(1)))  # a single row
    idf = df.withColumn("__one", F.lit(1)).join(one, "__one")
    idf = idf.select("term", "avg", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * _saturated(F.col("tf"), F.col("__len"), F.col("avg"))
    # what a term adds to a document is computed before the queries multiply it
    parts = tf.join(small(idf), "term").select("id", *keys, "term", part.alias("part"))
    pairs = parts.join(small(wanted), "term")
    if same is not None:
        pairs = pairs.where(F.col(same).eqNullSafe(F.col("__same")))
    if but_own:
        pairs = pairs.where("id <> query_id")
    scored = pairs.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero or the lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def quantised(v: Column) -> Column:
    """Whole numbers from -127 to 127, scaled by the largest component."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.when(top > 0, F.rint(x.cast("double") * 127 / top)).otherwise(0.0).cast("tinyint"))


def normalised(v: Column) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(dot(d, d))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def top(df: DataFrame, order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows with ranks from 1."""
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fused(lexical: DataFrame, semantic: DataFrame, w_lexical: float = 1.0, w_semantic: float = 1.0) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked legs (id, rank, score)."""
    a = lexical.select(F.col("id").alias("a"), F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    b = semantic.select(F.col("id").alias("b"), F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    score = part(w_lexical, "lexical_rank") + part(w_semantic, "semantic_rank")
    best = F.least("lexical_rank", "semantic_rank").alias("best_rank")  # breaks ties before the id
    return both.select(F.coalesce("a", "b").alias("id"), score.alias("base"), best, "lexical_rank", "semantic_rank", "lexical_score", "semantic_score")


def weight_or(option: float | None, configured: float) -> float:
    """A weight given with a call counts if it is above 0, else the configured one."""
    return option if option is not None and option > 0 else configured


def confidence_prior(confidence: Column, relevance: Column | None = None) -> Column:
    out = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    return out if relevance is None else out * F.least(F.greatest(relevance, F.lit(0.1)), F.lit(1.0))


def decay_prior(age_ms: Column, fact_type: Column, exempt: list[str], tau_days: float = 90.0) -> Column:
    if tau_days <= 0:
        return F.lit(1.0)
    fade = F.exp(-F.greatest(age_ms, F.lit(0)) / (tau_days * 86_400_000))
    return F.when(fact_type.isin(exempt), 1.0).otherwise(fade)


def type_prior(fact_type: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(fact_type == name, F.lit(w)).otherwise(out)
    return out


def centrality_prior(n_facts: Column, weight: float) -> Column:
    return 1 + weight * F.log10(1 + n_facts)


def feedback_prior(bias: Column, weight: float = 0.1) -> Column:
    return F.least(F.greatest(1 + weight * F.tanh(F.coalesce(bias, F.lit(0.0))), F.lit(0.1)), F.lit(2.0))


def feedback_bias(feedback: DataFrame) -> DataFrame:
    """Per fact: 1 for each helpful vote, -0.5 for each other."""
    return feedback.groupBy("fact_id").agg(F.sum(F.when(F.col("helpful"), 1.0).otherwise(-0.5)).alias("bias"))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def promotes(probe: DataFrame, least_hits: int, query_is_cjk: bool) -> bool:
    """Whether a lexical probe is too weak to stand alone; runs one small job."""
    rows = probe.select("score").orderBy(F.desc("score")).limit(least_hits).collect()
    best = rows[0]["score"] if rows else 0.0
    return len(rows) < least_hits or best < 1.0 or (query_is_cjk and best < 2.0)


def reranked(ranked: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Order the first ``k`` by ``scorer``, ties by their old rank; the tail stays."""
    head = F.col("rank") <= k
    order = [F.desc(head), F.desc(F.when(head, scorer)), F.col("rank")]
    return ranked.withColumn("new_rank", F.row_number().over(Window.orderBy(*order)))


def with_archive(hot: DataFrame, cold: DataFrame, limit: int) -> DataFrame:
    """(id, score, tier, rank): hits of both tiers (id, score) in one ranking; equal scores
    go to the hot tier, and a fact in both counts there."""
    both = prefer(hot.select("id", "score", F.lit(0).alias("tier")), cold.select("id", "score", F.lit(1).alias("tier")))
    return top(both, [F.desc("score"), F.col("tier"), F.col("id")], limit)


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int, scorer: Column | None = None, rerank_k: int = 0, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(id, score, rank) of two ranked legs, fused; with a ``scorer`` over its columns the
    window is widened to max(limit, rerank_k, 20) rows, whose head it orders anew."""
    both = fused(lexical, semantic, *weights).withColumn("score", F.round("base", 9))
    window = limit if scorer is None else max(limit, rerank_k, 20)
    rows = top(both, [F.desc("score"), F.col("best_rank"), F.col("id")], window)
    if scorer is not None:
        rows = reranked(rows, scorer, rerank_k).drop("rank").withColumnRenamed("new_rank", "rank")
    return rows.where(F.col("rank") <= limit).select("id", "score", "rank")


def within_facts(neighbours: DataFrame, bridge: DataFrame, cap: int) -> DataFrame:
    """At most ``cap / neighbours`` facts, one at least, of each neighbour entity."""
    n = max(1, neighbours.count())
    by = Window.partitionBy("entity_id").orderBy("fact_id")
    rows = bridge.join(neighbours, "entity_id", "left_semi").withColumn("pos", F.row_number().over(by))
    return rows.where(F.col("pos") <= max(1, cap // n)).orderBy("entity_id", "pos").limit(cap)
