"""Queries of lexical, vector and hybrid ranking, and of retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake import views as v
from factlake.operators import aggregates as a
from factlake.operators import filters as f
from factlake.operators import postings
from factlake.operators import quality as q
from factlake.operators import ranking as r
from factlake.plans.registry import query
from factlake.views import sql

QUERY = "license token worthless pathetic version"
TERMS = r.query_terms(QUERY)
NOW = 1_710_000_000_000

BM25 = f"""stat AS (SELECT count(*) AS n, avg(len) AS avgdl FROM (SELECT len(list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS len FROM texts)),
lens AS (SELECT id, count(*) AS len FROM tokens GROUP BY 1),
tf AS (SELECT id, term, count(*) AS tf FROM tokens WHERE term IN {tuple(TERMS)} GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm25 AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
    FROM tf JOIN dfs USING (term) JOIN lens USING (id), stat GROUP BY 1),
lexical AS (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, content, source, source_id, id) AS rank FROM bm25 JOIN texts USING (id) QUALIFY rank <= 200)"""
COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
SEMANTIC = f"""semantic AS (SELECT vec_id AS id, round({COS}, 6) AS score, row_number() OVER (ORDER BY round({COS}, 6) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 200)"""


def index(spark: SparkSession, d: str) -> postings.Index:
    """The stored index of the texts; the first search of a table builds it."""
    return postings.index_of(spark, v.texts(spark, d), tag="source_id")


def lexical_leg(spark: SparkSession, d: str, limit: int = 200) -> DataFrame:
    return index(spark, d).search(QUERY, limit, v.texts(spark, d))


def many(spark: SparkSession, d: str, queries: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` texts of each query, equal scores by id."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return index(spark, d).search_many(queries, limit).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first row stands for the query's."""
    return list(v.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def semantic_leg(spark: SparkSession, d: str, limit: int = 200) -> DataFrame:
    target = r.literal_vector(query_vector(spark, d))
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(r.cosine(F.col("embedding"), target), 6).alias("score"))
    return r.top(rows, [F.desc("score"), F.col("id")], limit)


@query("r1_document_text", sql("SELECT id, concat_ws(' ', source, source_id, content) AS document FROM texts"))
def r1(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).select("id", F.concat_ws(" ", "source", "source_id", "content").alias("document"))


@query("r3_bm25_topk", sql("SELECT id, score, rank FROM lexical WHERE rank <= 10", BM25))
def r3(spark: SparkSession, d: str) -> DataFrame:
    return lexical_leg(spark, d, 10)


@query("r3_bm25_namespace", sql("SELECT id, round(score, 6) AS score FROM bm25 JOIN texts USING (id) WHERE texts.source_id = 'fr' ORDER BY round(score, 6) DESC, content, source, source_id, id LIMIT 10", BM25))
def r3n(spark: SparkSession, d: str) -> DataFrame:
    """The namespace filter comes first; statistics are of the whole corpus."""
    return r.bm25(v.texts(spark, d), QUERY, 10, where=F.col("source_id") == "fr").select("id", "score")


@query("r4_tokens", sql("SELECT id, count(*) AS n, count(DISTINCT term) AS n_distinct FROM tokens GROUP BY 1"))
def r4(spark: SparkSession, d: str) -> DataFrame:
    t = r.tokens(F.col("content"))
    return v.texts(spark, d).select("id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct")).where("n > 0")


@query("a25_corpus_stats", sql("SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM tokens GROUP BY 1"))
def a25(spark: SparkSession, d: str) -> DataFrame:
    per = v.texts(spark, d).select("id", F.explode(r.tokens(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("r38_index_statistics", sql("SELECT term, count(DISTINCT id) AS df FROM tokens GROUP BY 1"))
def r38s(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies from the heads of the stored blocks alone."""
    stored = index(spark, d)
    return stored.frequencies(stored.postings())


@query("r38_segments", sql("""SELECT item_id AS query_id, id, score, rank FROM (SELECT item_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, id) AS rank FROM (
SELECT item_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM asked JOIN ktf USING (term) JOIN kdf USING (term), kstat GROUP BY 1, 2)) WHERE rank <= 5""",
    """kept AS (SELECT id, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM texts WHERE id % 5 <> 0),
kstat AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM kept),
ktf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM kept) GROUP BY ALL),
kdf AS (SELECT term, count(*) AS df FROM ktf GROUP BY 1),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark))"""))
def r38(spark: SparkSession, d: str) -> DataFrame:
    """Three segments, a fifth of the documents removed, one segment folded in: the scores are those of the documents that are left."""
    texts, stored = v.texts(spark, d), postings.Index(spark)
    stored.add(texts.where("id % 2 = 0"))
    stored.add(texts.where("id % 2 = 1 AND id % 3 <> 0"))
    stored.remove(texts.where("id % 10 = 5 OR id % 10 = 0").select("id"))
    stored.merge()
    stored.add(texts.where("id % 2 = 1 AND id % 3 = 0"))
    stored.remove(texts.where("id % 5 = 0").select("id"))
    queries = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return stored.search_many(queries, 5).withColumn("rank", F.row_number().over(by)).where("rank <= 5")


@query("r5_semantic_text", sql("SELECT id, concat_ws(chr(10), content, source_id, source) AS document FROM texts"))
def r5(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).select("id", F.concat_ws("\n", "content", "source_id", "source").alias("document"))


QUANT = "list_transform(embedding::DOUBLE[], lambda x: round_even(x * 127 / list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y))), 0)::INT)"


@query("r6_quantised", sql(f"SELECT vec_id, array_to_string({QUANT}, ',') AS q FROM embeddings"))
def r6(spark: SparkSession, d: str) -> DataFrame:
    q8 = F.array_join(r.quantised(F.col("embedding")).cast("array<string>"), ",")
    return v.table(spark, d, "embeddings").select("vec_id", q8.alias("q"))


@query("r7_cosine_i8", sql(f"""SELECT vec_id, round(list_cosine_similarity(q, (SELECT {QUANT}::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
FROM (SELECT vec_id, {QUANT}::DOUBLE[] AS q FROM embeddings)"""))
def r7(spark: SparkSession, d: str) -> DataFrame:
    target = r.quantised(r.literal_vector(query_vector(spark, d)))
    score = r.cosine(r.quantised(F.col("embedding")), target)
    return v.table(spark, d, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@query("r8_cosine", sql(f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings"))
def r8(spark: SparkSession, d: str) -> DataFrame:
    target = r.literal_vector(query_vector(spark, d))
    return v.table(spark, d, "embeddings").select("vec_id", F.round(r.cosine(F.col("embedding"), target), 6).alias("score"))


@query("r9_normalised", sql("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / pow(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 2), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings"))
def r9(spark: SparkSession, d: str) -> DataFrame:
    n = r.normalised(F.col("embedding"))
    rows = v.table(spark, d, "embeddings").select("vec_id", n.alias("n"))
    return rows.select("vec_id", F.round(r.dot(F.col("n"), F.col("n")), 6).alias("norm"), F.round(F.element_at("n", 1), 6).alias("first"))


@query("t2_semantic_topk", sql("SELECT id, score, rank FROM semantic WHERE rank <= 20", SEMANTIC))
def t2(spark: SparkSession, d: str) -> DataFrame:
    return semantic_leg(spark, d, 20)


FUSED = """fused AS (SELECT coalesce(l.id, s.id) AS id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(0.5 / (60 + s.rank), 0) AS base,
l.rank AS lexical_rank, s.rank AS semantic_rank, least(l.rank, s.rank) AS best_rank FROM lexical l FULL JOIN semantic s ON l.id = s.id)"""


@query("j4_fusion_join", sql("SELECT id, lexical_rank, semantic_rank FROM fused", BM25, SEMANTIC, FUSED))
def j4(spark: SparkSession, d: str) -> DataFrame:
    both = r.fused(lexical_leg(spark, d), semantic_leg(spark, d), 1.0, 0.5)
    return both.select("id", "lexical_rank", "semantic_rank")


@query("r15_weighted_rrf", sql("SELECT id, round(base, 9) AS score FROM fused ORDER BY round(base, 9) DESC, best_rank, id LIMIT 20", BM25, SEMANTIC, FUSED))
def r15(spark: SparkSession, d: str) -> DataFrame:
    both = r.fused(lexical_leg(spark, d), semantic_leg(spark, d), 1.0, 0.5).withColumn("score", F.round("base", 9))
    return f.page(both, [F.desc("score"), F.col("best_rank"), F.col("id")], 20).select("id", "score")


@query("r34_server_rrf", sql("""SELECT coalesce(l.id, s.id) AS id, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score,
l.score AS lexical_score, s.score AS semantic_score FROM lexical l FULL JOIN semantic s ON l.id = s.id""", BM25, SEMANTIC))
def r34(spark: SparkSession, d: str) -> DataFrame:
    both = r.fused(lexical_leg(spark, d), semantic_leg(spark, d))
    return both.select("id", F.round("base", 9).alias("score"), "lexical_score", "semantic_score")


WEIGHTS = {"signup": 2.0, "purchase": 1.5, "view": 0.5}
PRIORS = f"""bias AS (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1.0 ELSE -0.5 END)::DOUBLE AS bias FROM labels GROUP BY 1),
central AS (SELECT entity, count(*) AS n FROM facts GROUP BY 1),
priors AS (SELECT f.id, least(greatest(source_confidence, 0), 1) AS confidence,
CASE WHEN fact_type IN ('signup') THEN 1.0 ELSE exp(-greatest({NOW} - created_at, 0) / (90.0 * 86400000)) END AS decay,
CASE fact_type WHEN 'signup' THEN 2.0 WHEN 'purchase' THEN 1.5 WHEN 'view' THEN 0.5 ELSE 1.0 END AS weight,
1 + 0.2 * log10(1 + n) AS centrality, least(greatest(1 + 0.1 * tanh(coalesce(bias, 0)), 0.1), 2.0) AS feedback
FROM facts f JOIN central USING (entity) LEFT JOIN bias ON doc_id = f.id)"""


def _priors(spark: SparkSession, d: str) -> DataFrame:
    facts = v.facts(spark, d)
    votes = v.table(spark, d, "labels").select(F.col("doc_id").alias("fact_id"), (F.col("quality") == 1).alias("helpful"))
    n = facts.groupBy("entity").agg(F.count("*").alias("n"))
    rows = facts.join(n, "entity").join(r.feedback_bias(votes), F.col("id") == F.col("fact_id"), "left")
    return rows.select(
        "id",
        r.confidence_prior(F.col("source_confidence")).alias("confidence"),
        r.decay_prior(NOW - F.col("created_at"), F.col("fact_type"), ["signup"]).alias("decay"),
        r.type_prior(F.col("fact_type"), WEIGHTS).alias("weight"),
        r.centrality_prior(F.col("n"), 0.2).alias("centrality"),
        r.feedback_prior(F.col("bias")).alias("feedback"),
    )


def _prior_query(name: str, column: str) -> None:
    @query(name, sql(f"SELECT id, round({column}, 6) AS prior FROM priors", PRIORS))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _priors(spark, d).select("id", F.round(column, 6).alias("prior"))


for _name, _column in (
    ("r16_confidence_prior", "confidence"), ("r17_time_decay", "decay"), ("r18_type_weight", "weight"),
    ("r19_centrality_prior", "centrality"), ("r20_feedback_prior", "feedback"),
):
    _prior_query(_name, _column)


@query("t3_fused_topk", sql("""SELECT id, round(base * coalesce(confidence, 1) * coalesce(decay, 1) * coalesce(weight, 1) * coalesce(centrality, 1) * coalesce(feedback, 1), 9) AS score
FROM fused LEFT JOIN priors USING (id) ORDER BY score DESC, best_rank, id LIMIT 25""", BM25, SEMANTIC, FUSED, PRIORS))
def t3(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid ranking with every prior."""
    both = r.fused(lexical_leg(spark, d), semantic_leg(spark, d), 1.0, 0.5).join(_priors(spark, d), "id", "left")
    score = F.col("base")
    for c in ("confidence", "decay", "weight", "centrality", "feedback"):
        score = score * F.coalesce(F.col(c), F.lit(1.0))
    return f.page(both.withColumn("score", F.round(score, 9)), [F.desc("score"), F.col("best_rank"), F.col("id")], 25).select("id", "score")


@query("r12_prefilter_then_semantic", sql(f"SELECT vec_id AS id, round({COS}, 6) AS score FROM embeddings WHERE vec_id IN (SELECT id FROM lexical WHERE rank <= 50)", BM25))
def r12(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates, rescored by their vectors."""
    target = r.literal_vector(query_vector(spark, d))
    vectors = v.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id").join(lexical_leg(spark, d, 50).select("id"), "id", "left_semi")
    return vectors.select("id", F.round(r.cosine(F.col("embedding"), target), 6).alias("score"))


@query("r13_hybrid_rank", sql("""SELECT id, row_number() OVER (ORDER BY round(base, 9) DESC, best_rank, id) AS rank FROM fused QUALIFY rank <= 30""", BM25, SEMANTIC, FUSED))
def r13(spark: SparkSession, d: str) -> DataFrame:
    both = r.fused(lexical_leg(spark, d), semantic_leg(spark, d), 1.0, 0.5).withColumn("score", F.round("base", 9))
    return r.top(both, [F.desc("score"), F.col("best_rank"), F.col("id")], 30).select("id", "rank")


@query("r25_hybrid_rerank", sql("""SELECT id, score, new_rank AS rank FROM (SELECT id, f.score, row_number() OVER (ORDER BY f.rank <= 15 DESC, CASE WHEN f.rank <= 15 THEN coalesce(l.score, 0) END DESC NULLS LAST, f.rank) AS new_rank
FROM (SELECT id, round(base, 9) AS score, row_number() OVER (ORDER BY round(base, 9) DESC, best_rank, id) AS rank FROM fused QUALIFY rank <= 20) f LEFT JOIN lexical l USING (id)) WHERE new_rank <= 10""", BM25, SEMANTIC, FUSED))
def r25(spark: SparkSession, d: str) -> DataFrame:
    """The whole hybrid entry: weights given with the call or configured, a window wider than the result, its head ordered anew."""
    weights = (r.weight_or(1.0, 0.7), r.weight_or(0.0, 0.5))
    scorer = F.coalesce("lexical_score", F.lit(0.0))
    return r.hybrid(lexical_leg(spark, d), semantic_leg(spark, d), 10, scorer, 15, weights)


@query("r23_cjk", sql("SELECT id FROM (SELECT id, content || CASE WHEN id % 7 = 0 THEN [' 東京', ' 서울', ' かな'][id % 3 + 1] ELSE '' END AS content FROM texts) WHERE regexp_matches(content, '[\\x{1100}-\\x{11ff}\\x{3040}-\\x{30ff}\\x{3130}-\\x{318f}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}]')"))
def r23(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh text gets a word of Han, Hangul or kana."""
    word = F.element_at(F.array(F.lit(" 東京"), F.lit(" 서울"), F.lit(" かな")), (F.col("id") % 3 + 1).cast("int"))
    texts = v.texts(spark, d).withColumn("content", F.concat("content", F.when(F.col("id") % 7 == 0, word).otherwise("")))
    return texts.where(r.has_cjk(F.col("content"))).select("id")


@query("r24_adaptive_search", sql("""SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round(base, 9) DESC, best_rank, id) AS rank FROM fused
WHERE (SELECT count(*) < 10 OR max(score) < 1.0 FROM (SELECT score FROM lexical WHERE rank <= 10))
UNION ALL SELECT id, rank FROM lexical WHERE NOT (SELECT count(*) < 10 OR max(score) < 1.0 FROM (SELECT score FROM lexical WHERE rank <= 10))) WHERE rank <= 10""", BM25, SEMANTIC, FUSED))
def r24(spark: SparkSession, d: str) -> DataFrame:
    """Lexical if the probe is strong enough, else hybrid."""
    probe = lexical_leg(spark, d)
    if not r.promotes(probe, 10, False):
        return probe.where("rank <= 10").select("id", "rank")
    both = r.fused(probe, semantic_leg(spark, d), 1.0, 0.5).withColumn("score", F.round("base", 9))
    return r.top(both, [F.desc("score"), F.col("best_rank"), F.col("id")], 10).select("id", "rank")


@query("r26_rerank_head", sql("""SELECT id, row_number() OVER (ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN length(content) END DESC, rank) AS new_rank
FROM lexical JOIN texts USING (id) WHERE rank <= 30""", BM25))
def r26(spark: SparkSession, d: str) -> DataFrame:
    """A pluggable scorer, here the length, reorders the first ten."""
    head = lexical_leg(spark, d, 30).join(v.texts(spark, d).select("id", "content"), "id")
    return r.reranked(head, F.length("content"), 10).select("id", "new_rank")


@query("r36_many_queries", sql("""SELECT item_id AS query_id, id, score, rank FROM (SELECT item_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, id) AS rank FROM (
SELECT item_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM (SELECT DISTINCT item_id, term FROM qt) JOIN atf USING (term) JOIN adf USING (term) JOIN lens USING (id), stat GROUP BY 1, 2)) WHERE rank <= 5""",
    BM25, """qt AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
atf AS (SELECT id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
adf AS (SELECT term, ln(1 + ((SELECT n FROM stat) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM atf GROUP BY 1)"""))
def r36(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark passage as a query over all documents."""
    queries = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return many(spark, d, queries, 5)


@query("r40_temporal_bias", sql("SELECT id, round(source_confidence * exp(-abs(created_at - 1704844800000) / 86400000.0 / 30.0), 9) AS score FROM facts"))
def r40(spark: SparkSession, d: str) -> DataFrame:
    days = F.abs(F.col("created_at") - 1_704_844_800_000) / 86_400_000.0
    return v.facts(spark, d).select("id", F.round(F.col("source_confidence") * F.exp(-days / 30.0), 9).alias("score"))


@query("t8_global_merge", sql("""SELECT store, id, row_number() OVER (ORDER BY score DESC, id, store) AS rank FROM (SELECT 'a' AS store, id, score FROM lexical UNION ALL SELECT 'b', id, score FROM semantic) QUALIFY rank <= 40""", BM25, SEMANTIC))
def t8(spark: SparkSession, d: str) -> DataFrame:
    both = lexical_leg(spark, d).withColumn("store", F.lit("a")).unionByName(semantic_leg(spark, d).withColumn("store", F.lit("b")))
    return r.top(both.drop("rank"), [F.desc("score"), F.col("id"), F.col("store")], 40).select("store", "id", "rank")


RANKED = """sizes AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS relevant, size - 1 AS n_relevant, row_number() OVER (PARTITION BY a.vec_id ORDER BY
round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a
JOIN embeddings b ON a.vec_id <> b.vec_id JOIN sizes ON sizes.label = a.label QUALIFY rank <= 30)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all others, its
    best 30; a label is the judgement."""
    e = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    queries = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("ql"))
    runs = q.retrieve(queries, e, 30).withColumn("relevant", F.col("label") == F.col("ql"))
    sizes = e.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("n_relevant"))
    return runs.join(sizes, "ql").select("query_id", "id", "relevant", "n_relevant", "rank")


@query("a20_precision_recall", sql("""SELECT query_id, count(*) FILTER (relevant AND rank <= 10) / 10.0 AS precision,
round(count(*) FILTER (relevant AND rank <= 10) / nullif(max(n_relevant), 0)::DOUBLE, 9) AS recall FROM pairs GROUP BY 1""", RANKED))
def a20(spark: SparkSession, d: str) -> DataFrame:
    return q.precision_recall(_runs(spark, d), 10)


@query("a21_recall_mrr", sql("""SELECT count(*) FILTER (first <= 1) / count(*)::DOUBLE AS r1, count(*) FILTER (first <= 5) / count(*)::DOUBLE AS r5, count(*) FILTER (first <= 10) / count(*)::DOUBLE AS r10,
round(avg(coalesce(1.0 / first, 0)), 9) AS mrr FROM (SELECT query_id, min(rank) FILTER (relevant) AS first FROM pairs GROUP BY 1)""", RANKED))
def a21(spark: SparkSession, d: str) -> DataFrame:
    return q.recall_mrr(_runs(spark, d))


@query("a18_feedback_bias", sql("SELECT doc_id AS fact_id, sum(CASE WHEN quality = 1 THEN 1.0 ELSE -0.5 END)::DOUBLE AS bias FROM labels GROUP BY 1"))
def a18(spark: SparkSession, d: str) -> DataFrame:
    return r.feedback_bias(v.table(spark, d, "labels").select(F.col("doc_id").alias("fact_id"), (F.col("quality") == 1).alias("helpful")))


@query("a19_adapter_eval", sql("""SELECT round(avg(helpful) FILTER (rank <= 10), 9) AS precision_at_10, round(avg(helpful), 9) AS base_rate FROM (
SELECT quality AS helpful, row_number() OVER (ORDER BY CASE WHEN quality = 1 THEN 1.0 ELSE -0.5 END DESC, doc_id) AS rank FROM labels)"""))
def a19(spark: SparkSession, d: str) -> DataFrame:
    votes = v.table(spark, d, "labels").select(F.col("doc_id").alias("fact_id"), (F.col("quality") == 1).alias("helpful"))
    return q.adapter_eval(votes, r.feedback_bias(votes))


@query("a28_retrieval_report", sql("""SELECT label, count(*) AS n, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 9) AS r3, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 9) AS r10,
round(avg(coalesce(1.0 / first, 0)), 9) AS mrr FROM (SELECT query_id, min(rank) FILTER (relevant) AS first FROM pairs GROUP BY 1) JOIN embeddings ON vec_id = query_id GROUP BY 1""", RANKED))
def a28(spark: SparkSession, d: str) -> DataFrame:
    kinds = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return q.report_by(_runs(spark, d), kinds, "label")


@query("a29_gap_per_k", sql("""SELECT k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 9) AS found FROM (SELECT query_id, min(rank) FILTER (relevant) AS first FROM pairs GROUP BY 1),
(SELECT unnest([1, 3, 5, 10, 30]) AS k) GROUP BY 1""", RANKED))
def a29(spark: SparkSession, d: str) -> DataFrame:
    return q.found_per_k(_runs(spark, d), [1, 3, 5, 10, 30])


@query("u7_recall_overlap", sql("SELECT query_id, count(*) AS overlap FROM pairs WHERE relevant AND rank <= 5 GROUP BY 1", RANKED))
def u7(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("relevant AND rank <= 5").groupBy("query_id").agg(F.count("*").alias("overlap"))


@query("w3_facts_per_neighbour", sql("""SELECT entity_id, fact_id, pos FROM (SELECT entity_id, fact_id, row_number() OVER (PARTITION BY entity_id ORDER BY fact_id) AS pos FROM fact_entities
WHERE entity_id IN (SELECT source_id FROM relations WHERE target_id = 'nation:2')) WHERE pos <= greatest(1, 500 // (SELECT count(DISTINCT source_id) FROM relations WHERE target_id = 'nation:2')) ORDER BY entity_id, pos LIMIT 500"""))
def w3(spark: SparkSession, d: str) -> DataFrame:
    near = f.edges_at(v.relations(spark, d), "nation:2", "reverse").select(F.col("source_id").alias("entity_id")).distinct()
    return r.within_facts(near, v.fact_entities(spark, d), 500).select("entity_id", "fact_id", "pos")


@query("a30_session_rollup", sql("""SELECT user AS session, count(*) AS hits, max(source_confidence) AS best, min(created_at) AS first_seen FROM (SELECT entity AS user, source_confidence, created_at,
row_number() OVER (PARTITION BY entity ORDER BY source_confidence DESC, id) AS n FROM facts) WHERE n <= 5 GROUP BY 1"""))
def a30(spark: SparkSession, d: str) -> DataFrame:
    rows = a.top_per(v.facts(spark, d), ["entity"], [F.desc("source_confidence"), F.col("id")], 5)
    return rows.groupBy(F.col("entity").alias("session")).agg(
        F.count("*").alias("hits"), F.max("source_confidence").alias("best"), F.min("created_at").alias("first_seen")
    )


@query("r33_server_auto", sql("""SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) DESC, least(l.rank, s.rank), id) AS rank FROM lexical l FULL JOIN semantic s USING (id)
WHERE (SELECT count(*) < 3 OR max(score) < 1.25 FROM lexical) UNION ALL SELECT id, rank FROM lexical WHERE NOT (SELECT count(*) < 3 OR max(score) < 1.25 FROM lexical)) WHERE rank <= 10""", BM25, SEMANTIC))
def r33(spark: SparkSession, d: str) -> DataFrame:
    """Lexical if three hits and a best score of 1.25 say so, else both legs, unweighted."""
    probe = lexical_leg(spark, d)
    best = probe.where("rank <= 3").agg(F.count("*").alias("n"), F.max("score").alias("top")).first()
    if best["n"] >= 3 and best["top"] >= 1.25:
        return probe.where("rank <= 10").select("id", "rank")
    both = r.fused(probe, semantic_leg(spark, d)).withColumn("score", F.round("base", 9))
    return r.top(both, [F.desc("score"), F.col("best_rank"), F.col("id")], 10).select("id", "rank")


@query("r37_aggregate_many", sql("""SELECT request, count(*) AS n, round(max(source_confidence), 9) AS best FROM facts JOIN (VALUES ('a', 'ns1', 'click'), ('b', 'ns2', 'error'), ('c', 'ns1', 'error')) t(request, ns, kind)
ON source_id = ns AND fact_type = kind GROUP BY 1"""))
def r37(spark: SparkSession, d: str) -> DataFrame:
    """Several aggregate requests in one pass over the facts."""
    asked = spark.createDataFrame([("a", "ns1", "click"), ("b", "ns2", "error"), ("c", "ns1", "error")], "request string, source_id string, fact_type string")
    rows = v.facts(spark, d).join(F.broadcast(asked), ["source_id", "fact_type"])
    return rows.groupBy("request").agg(F.count("*").alias("n"), F.round(F.max("source_confidence"), 9).alias("best"))


@query("r39_golden_set", sql("""SELECT round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9) AS found, count(*) AS queries FROM (SELECT item_id, count(*) FILTER (contains(content, text)) AS hits
FROM best5 JOIN benchmark USING (item_id) JOIN texts USING (id) GROUP BY 1)""",
    BM25, """qt AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
atf AS (SELECT id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
adf AS (SELECT term, ln(1 + ((SELECT n FROM stat) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM atf GROUP BY 1),
best5 AS (SELECT item_id, id FROM (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, id) AS rank FROM (
SELECT item_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM (SELECT DISTINCT item_id, term FROM qt) JOIN atf USING (term) JOIN adf USING (term) JOIN lens USING (id), stat GROUP BY 1, 2)) WHERE rank <= 5)"""))
def r39(spark: SparkSession, d: str) -> DataFrame:
    """Share of benchmark passages that stand in one of their five best documents."""
    queries = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = v.texts(spark, d)
    best = many(spark, d, queries, 5).join(texts.select("id", "content"), "id").join(queries, "query_id")
    per = best.groupBy("query_id").agg(F.count_if(F.col("content").contains(F.col("query"))).alias("hits"))
    return per.agg(F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 9).alias("found"), F.count("*").alias("queries"))
