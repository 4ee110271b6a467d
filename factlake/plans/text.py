"""Queries of text functions: types, sentences, slots, links, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import views as v
from factlake.functions import markdown as m
from factlake.functions import text as x
from factlake.plans.registry import query
from factlake.views import sql

#: Sentences that orders state, by priority; they exercise cues, slots and links.
SAYS = {
    "1-URGENT": "We decided to ship three items before yesterday",
    "2-HIGH": "I prefer rail. Never again by sea",
    "3-MEDIUM": "Bob: we learned that two kits were late",
    "4-NOT SPECIFIED": "Why was it late?",
    "5-LOW": "Always check [[Part A]] which depends on [[Supplier B]]",
}
UNITS = {"F": "days", "O": "weeks", "P": "hours"}
NAMES = ["Order", "rail", "Supplier B", "AI"]


def memos(spark: SparkSession, d: str) -> DataFrame:
    """Orders as short notes with money, durations, dates and cues."""
    o = v.table(spark, d, "orders")
    pick = lambda c, table: F.create_map(*[F.lit(s) for kv in table.items() for s in kv])[F.col(c)]
    content = F.concat(
        F.lit("Order "), F.col("o_orderkey"), F.lit(" cost $"), F.format_string("%.2f", "o_totalprice"), F.lit(" and took "),
        F.col("o_orderkey") % 29, F.lit(" "), pick("o_orderstatus", UNITS), F.lit(" on "),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(". "), pick("o_orderpriority", SAYS), F.lit("."),
    )
    return o.select(F.col("o_orderkey").alias("id"), content.alias("content"), v.millis("o_orderdate").alias("observed_at"))


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in table.items()) + " END"


MEMOS = f"""memos AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' cost $' || printf('%.2f', o_totalprice) || ' and took ' || (o_orderkey % 29) || ' ' ||
{_case('o_orderstatus', UNITS)} || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || '. ' || {_case('o_orderpriority', SAYS)} || '.' AS content,
epoch_us(o_orderdate) // 1000 AS observed_at, o_orderkey % 29 AS n, o_orderstatus AS unit, o_totalprice AS price, o_orderdate::DATE AS day, o_orderpriority AS priority FROM orders)"""
SENTENCES = r"""sent AS (SELECT id, generate_subscripts(s, 1) AS i, unnest(s) AS sentence FROM (SELECT id, list_filter(list_transform(string_split_regex(content, '[.!?;\n\r]'),
lambda p: regexp_replace(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^>+\s*', ''), '^\p{Lu}[\p{L}\p{N}_-]{0,31}:\s*', '')), lambda p: p <> '') AS s FROM memos))"""


@query("x1_trigram_similarity", sql(r"""SELECT a, b, round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE, 6) AS similarity FROM (SELECT a.n_name AS a, b.r_name AS b,
list_distinct(list_transform(range(1, length(a.n_name) + 3), lambda i: substr('  ' || lower(a.n_name) || '  ', i, 3))) AS ga,
list_distinct(list_transform(range(1, length(b.r_name) + 3), lambda i: substr('  ' || lower(b.r_name) || '  ', i, 3))) AS gb FROM nation a JOIN region b ON n_regionkey = r_regionkey)"""))
def x1(spark: SparkSession, d: str) -> DataFrame:
    n, r = v.table(spark, d, "nation"), v.table(spark, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return rows.withColumn("similarity", F.round(x.trigram_similarity(F.col("a"), F.col("b")), 6))


@query("x2_levenshtein", sql("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part"))
def x2(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("x3_jaro_winkler", sql("SELECT p_partkey, round(jaro_winkler_similarity(lower(p_name), lower(p_type)), 6) AS similarity FROM part"))
def x3(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select("p_partkey", F.round(x.jaro_winkler(F.lower("p_name"), F.lower("p_type")), 6).alias("similarity"))


@query("x4_best_fuzzy_match", sql(r"""SELECT wanted, arg_max(name, struct_pack(s := similarity, n := name)) AS best FROM (SELECT DISTINCT 'red widgt' AS wanted, p_name AS name,
round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE, 6) AS similarity FROM (SELECT p_name, list_distinct(list_transform(range(1, length(p_name) + 3), lambda i: substr('  ' || lower(p_name) || '  ', i, 3))) AS g,
list_distinct(list_transform(range(1, 12), lambda i: substr('  red widgt  ', i, 3))) AS q FROM part)) WHERE similarity >= 0.5 GROUP BY 1"""))
def x4(spark: SparkSession, d: str) -> DataFrame:
    names = v.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    score = F.round(x.trigram_similarity(F.lit("red widgt"), F.col("name")), 6)
    rows = names.withColumn("s", score).where("s >= 0.5")
    return rows.groupBy(F.lit("red widgt").alias("wanted")).agg(F.max_by("name", F.struct("s", "name")).alias("best"))


@query("x5_fuzzy_matches", sql(r"""SELECT DISTINCT p_name AS name, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE, 6) AS similarity FROM (SELECT p_name, list_distinct(list_transform(range(1, length(p_name) + 3), lambda i: substr('  ' || lower(p_name) || '  ', i, 3))) AS g,
list_distinct(list_transform(range(1, 12), lambda i: substr('  red widgt  ', i, 3))) AS q FROM part) WHERE round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE, 6) > 0.3"""))
def x5(spark: SparkSession, d: str) -> DataFrame:
    names = v.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("similarity", F.round(x.trigram_similarity(F.lit("red widgt"), F.col("name")), 6)).where("similarity > 0.3")


@query("x8_infer_fact_type", sql(f"SELECT id, {x.infer_fact_type_sql('content')} AS fact_type FROM texts"))
def x8(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).select("id", x.infer_fact_type(F.col("content")).alias("fact_type"))


@query("x8_memo_types", sql(f"SELECT id, {x.infer_fact_type_sql('content')} AS fact_type FROM memos", MEMOS))
def x8m(spark: SparkSession, d: str) -> DataFrame:
    return memos(spark, d).select("id", x.infer_fact_type(F.col("content")).alias("fact_type"))


@query("x10_sentences", sql("SELECT id, i - 1 AS pos, sentence FROM sent", MEMOS, SENTENCES))
def x10(spark: SparkSession, d: str) -> DataFrame:
    return memos(spark, d).select("id", F.posexplode(x.sentences(F.col("content"))).alias("pos", "sentence"))


CAND = f"""cand AS (SELECT id, i - 1 AS pos, sentence, {x.infer_fact_type_sql('sentence')} AS fact_type,
contains(lower(sentence), 'order') OR contains(lower(sentence), 'rail') OR contains(lower(sentence), 'supplier b') AS hit, octet_length(sentence::BLOB) AS n FROM sent)"""


@query("x13_candidates", sql("""SELECT id, pos, fact_type, round(least(1.0, 0.4 + CASE WHEN hit THEN 0.25 ELSE 0 END + CASE WHEN fact_type <> 'note' THEN 0.2 ELSE 0 END +
CASE WHEN n BETWEEN 30 AND 200 THEN 0.15 WHEN n < 30 THEN 0.05 ELSE 0 END), 6)::DOUBLE AS confidence FROM cand WHERE n BETWEEN 10 AND 600""", MEMOS, SENTENCES, CAND))
def x13(spark: SparkSession, d: str) -> DataFrame:
    found = x.candidates(memos(spark, d), NAMES)
    return found.select("id", "pos", "fact_type", F.round("confidence", 6).alias("confidence"))


@query("j13_sentence_entities", sql("SELECT id, pos, name FROM cand, (VALUES ('Order'), ('rail'), ('Supplier B')) t(name) WHERE n BETWEEN 10 AND 600 AND contains(lower(sentence), lower(name))", MEMOS, SENTENCES, CAND))
def j13(spark: SparkSession, d: str) -> DataFrame:
    return x.candidates(memos(spark, d), NAMES).select("id", "pos", F.explode("entities").alias("name"))


@query("x15_number_words", sql("SELECT id, replace(replace(content, 'three items', '3 items'), 'two kits', '2 kits') AS content FROM memos", MEMOS))
def x15(spark: SparkSession, d: str) -> DataFrame:
    return memos(spark, d).select("id", x.digits(F.col("content")).alias("content"))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    return memos(spark, d).select("id", "observed_at", F.explode(x.slots(F.col("content"), F.col("observed_at"))).alias("s")).select("id", "observed_at", "s.*")


@query("x16_currency_slots", sql("SELECT id, round(price * 100) AS value, 'USD' AS unit, '$' || printf('%.2f', price) AS raw FROM memos", MEMOS))
def x16(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).where("kind = 'currency'").select("id", "value", "unit", "raw")


@query("x17_duration_slots", sql("SELECT id, n * CASE unit WHEN 'F' THEN 86400 WHEN 'O' THEN 604800 ELSE 3600 END::DOUBLE AS value FROM memos", MEMOS))
def x17(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).where("kind = 'duration'").select("id", "value")


@query("x18_date_slots", sql("SELECT id, strftime(day, '%Y-%m-%d') AS day FROM memos UNION ALL SELECT id, strftime(day - INTERVAL 1 DAY, '%Y-%m-%d') FROM memos WHERE priority = '1-URGENT'", MEMOS))
def x18(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.date_from_unix_date((F.col("value") / x.DAY).cast("int")), "yyyy-MM-dd")
    return _slots(spark, d).where("kind = 'event_date'").select("id", day.alias("day"))


@query("x19_count_slots", sql("SELECT id, CASE priority WHEN '1-URGENT' THEN 3.0 ELSE 2.0 END::DOUBLE AS value FROM memos WHERE priority IN ('1-URGENT', '3-MEDIUM')", MEMOS))
def x19(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).where("kind = 'count'").select("id", "value")


@query("x20_structured_extract", sql("SELECT id, 2 + 1 + CASE priority WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS n, length('Order ' || id || ' cost ') AS first_start FROM memos", MEMOS))
def x20(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


@query("a8_sum_currency", sql("SELECT 'USD' AS unit, sum(round(price * 100)) AS total, count(*) AS mentions FROM memos", MEMOS))
def a8(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).where("kind = 'currency'").groupBy("unit").agg(F.sum("value").alias("total"), F.count("*").alias("mentions"))


@query("a9_sum_duration", sql("SELECT sum(s) AS seconds, round(sum(s) / 3600, 6) AS hours, round(sum(s) / 86400, 6) AS days, count(*) AS mentions FROM (SELECT n * CASE unit WHEN 'F' THEN 86400 WHEN 'O' THEN 604800 ELSE 3600 END::DOUBLE AS s FROM memos)", MEMOS))
def a9(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum("value")
    return _slots(spark, d).where("kind = 'duration'").agg(
        total.alias("seconds"), F.round(total / 3600, 6).alias("hours"), F.round(total / 86400, 6).alias("days"), F.count("*").alias("mentions")
    )


@query("a10_distinct_dates", sql("SELECT DISTINCT strftime(day, '%Y-%m-%d') AS day FROM (SELECT day FROM memos UNION ALL SELECT (day - INTERVAL 1 DAY)::DATE FROM memos WHERE priority = '1-URGENT')", MEMOS))
def a10(spark: SparkSession, d: str) -> DataFrame:
    return x18(spark, d).select("day").distinct()


@query("a11_timeline", sql("""SELECT id, day, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day) AS pos FROM (SELECT id, strftime(day, '%Y-%m-%d') AS day FROM memos
UNION ALL SELECT id, strftime(day - INTERVAL 1 DAY, '%Y-%m-%d') FROM memos WHERE priority = '1-URGENT'))""", MEMOS))
def a11(spark: SparkSession, d: str) -> DataFrame:
    """Dates of each note in order; a global order is the reader's sort."""
    from factlake.operators.aggregates import top_per

    return top_per(x18(spark, d), ["id"], [F.col("day")], 2**31 - 1).select("id", "day", "pos")


@query("a12_relevance_gate", sql("SELECT 'USD' AS unit, sum(round(price * 100)) AS total FROM memos WHERE list_cosine_similarity([price / 1000, n::DOUBLE, 1.0], [100.0, 10.0, 1.0]) >= 0.9", MEMOS))
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Slot totals over hits near the query: a small vector of price and time stands for the text."""
    from factlake.operators.ranking import cosine, literal_vector

    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 1000, (F.col("o_orderkey") % 29).cast("double"), F.lit(1.0)).alias("vec"))
    near = o.where(cosine(F.col("vec"), literal_vector([100.0, 10.0, 1.0])) >= 0.9).select("id")
    return _slots(spark, d).join(near, "id", "left_semi").where("kind = 'currency'").groupBy("unit").agg(F.sum("value").alias("total"))


@query("a31_structured_totals", sql("""SELECT kind, sum(value) AS total, count(*) AS mentions FROM (SELECT 'currency' AS kind, round(price * 100) AS value FROM memos
UNION ALL SELECT 'duration', n * CASE unit WHEN 'F' THEN 86400 WHEN 'O' THEN 604800 ELSE 3600 END FROM memos
UNION ALL SELECT 'count', CASE priority WHEN '1-URGENT' THEN 3.0 ELSE 2.0 END FROM memos WHERE priority IN ('1-URGENT', '3-MEDIUM')) GROUP BY 1""", MEMOS))
def a31(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).where("kind <> 'event_date'").groupBy("kind").agg(F.sum("value").alias("total"), F.count("*").alias("mentions"))


@query("x21_wiki_links", sql("SELECT id, unnest(['Part A', 'Supplier B']) AS target, 1 AS line FROM memos WHERE priority = '5-LOW'", MEMOS))
def x21(spark: SparkSession, d: str) -> DataFrame:
    return m.links(memos(spark, d)).select("id", "target", "line")


@query("x22_link_spans", sql("SELECT id, strpos(content, '[[Part A]]') - 1 AS first_start FROM memos WHERE priority = '5-LOW'", MEMOS))
def x22(spark: SparkSession, d: str) -> DataFrame:
    return memos(spark, d).select("id", F.get(m.link_spans(F.col("content")), F.lit(0))["start"].cast("long").alias("first_start")).where("first_start IS NOT NULL")


@query("x24_typed_relations", sql("SELECT id, 'Part A' AS source, 'depends_on' AS relation_type, 'Supplier B' AS target FROM memos WHERE priority = '5-LOW'", MEMOS))
def x24(spark: SparkSession, d: str) -> DataFrame:
    return m.typed_relations(memos(spark, d)).select("id", "source", "relation_type", "target")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as Markdown pages with frontmatter, links and sections."""
    s = v.table(spark, d, "supplier")
    content = F.concat(
        F.lit("---\ntype: Supplier\ntags: [seller, nation"), F.col("s_nationkey"), F.lit("]\naliases:\n- S"), F.col("s_suppkey"),
        F.lit("\ndate: 2024-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit("\n---\n# "), F.col("s_name"),
        F.lit("\nintro\n## Decision log\n[[Desk]] is part of [[NATION_"), F.col("s_nationkey"),
        F.lit("]]\n\n## Open Questions\nBalance "), F.format_string("%.2f", "s_acctbal"), F.lit("\n"),
    )
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("people/s"), F.col("s_suppkey"), F.lit(".md")).alias("path"), content.alias("content"))


@query("x27_frontmatter", sql("""SELECT s_suppkey AS id, s_name AS name, 'supplier' AS entity_type, 'seller,nation' || s_nationkey AS tags, 'S' || s_suppkey AS aliases,
epoch_us(make_date(2024, 1, (s_suppkey % 28 + 1)::INT)::TIMESTAMP) // 1000 AS observed_at FROM supplier"""))
def x27(spark: SparkSession, d: str) -> DataFrame:
    e = m.page_entities(pages(spark, d))
    return e.select("id", "name", "entity_type", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"), "observed_at")


@query("x28_sections", sql("""SELECT s_suppkey AS id, 'Decision log' AS heading, 'decision-log' AS anchor, 'decision' AS fact_type, '[[Desk]] is part of [[NATION_' || s_nationkey || ']]' AS content FROM supplier
UNION ALL SELECT s_suppkey, 'Open Questions', 'open-questions', 'question', 'Balance ' || printf('%.2f', s_acctbal) FROM supplier"""))
def x28(spark: SparkSession, d: str) -> DataFrame:
    s = m.sections(pages(spark, d))
    return s.select("id", "heading", "anchor", x.heading_fact_type(F.col("heading")).alias("fact_type"), "content")


@query("x30_path_types", sql("SELECT s_suppkey AS id, 'person' AS entity_type FROM supplier"))
def x30(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("id", m.entity_type_of(F.col("path")).alias("entity_type"))


@query("s12_page_relations", sql("SELECT s_suppkey AS id, 'Desk' AS source, 'part_of' AS relation_type, 'NATION_' || s_nationkey AS target FROM supplier"))
def s12(spark: SparkSession, d: str) -> DataFrame:
    return m.typed_relations(pages(spark, d)).select("id", "source", "relation_type", "target")


@query("x31_secrets", sql(r"""SELECT id, len(regexp_extract_all(content, '(?:^|[^A-Za-z0-9_-])(github_pat_[A-Za-z0-9_-]{9,}|sk-proj-[A-Za-z0-9_-]{4,}|xoxb-[A-Za-z0-9_-]{7,}|ghp_[A-Za-z0-9_-]{8,}|gho_[A-Za-z0-9_-]{8,}|AKIA[A-Za-z0-9_-]{12,}|AIza[A-Za-z0-9_-]{12,}|sk-[A-Za-z0-9_-]{9,})')) AS n FROM texts"""))
def x31(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).select("id", F.size(x.secrets(F.col("content"))).cast("long").alias("n"))


@query("x33_redaction", sql(r"""SELECT id, sha256(regexp_replace(content, '(^|[^A-Za-z0-9_-])(github_pat_[A-Za-z0-9_-]{9,}|sk-proj-[A-Za-z0-9_-]{4,}|xoxb-[A-Za-z0-9_-]{7,}|ghp_[A-Za-z0-9_-]{8,}|gho_[A-Za-z0-9_-]{8,}|AKIA[A-Za-z0-9_-]{12,}|AIza[A-Za-z0-9_-]{12,}|sk-[A-Za-z0-9_-]{9,})', '\1[secret]', 'g')) AS digest FROM texts"""))
def x33(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).select("id", x.content_hash(x.redacted(F.col("content"))).alias("digest"))


@query("x34_privacy_block", sql(r"""SELECT id FROM texts WHERE NOT regexp_matches(content, '(?:^|[^A-Za-z0-9_-])(github_pat_[A-Za-z0-9_-]{9,}|sk-proj-[A-Za-z0-9_-]{4,}|xoxb-[A-Za-z0-9_-]{7,}|ghp_[A-Za-z0-9_-]{8,}|gho_[A-Za-z0-9_-]{8,}|AKIA[A-Za-z0-9_-]{12,}|AIza[A-Za-z0-9_-]{12,}|sk-[A-Za-z0-9_-]{9,})')"""))
def x34(spark: SparkSession, d: str) -> DataFrame:
    return x.screened(v.texts(spark, d), "block")[0].select("id")


@query("x35_content_hash", sql("SELECT source_id, sha256(content) AS digest, min(id) AS id, count(*) AS n FROM texts GROUP BY 1, 2"))
def x35(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).groupBy("source_id", x.content_hash(F.col("content")).alias("digest")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("x36_text_edits", sql("SELECT id, replace(content, 'Order', 'Purchase') AS content FROM memos", MEMOS))
def x36(spark: SparkSession, d: str) -> DataFrame:
    return memos(spark, d).select("id", x.edited(F.col("content"), replace=("Order", "Purchase")).alias("content"))


CHUNKS = r"""parts AS (SELECT id, list_filter(list_transform(string_split_regex(content, '[.!?;\n\r]'),
lambda p: regexp_replace(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^>+\s*', ''), '^\p{Lu}[\p{L}\p{N}_-]{0,31}:\s*', '')), lambda p: p <> '') AS s FROM texts),
chunks AS (SELECT id, list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1]) + 1 + length(x[1]) <= 400
THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END, []::VARCHAR[]) AS c FROM parts)"""


@query("x37_chunks", sql("SELECT id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS chunk FROM chunks", CHUNKS))
def x37(spark: SparkSession, d: str) -> DataFrame:
    return v.texts(spark, d).select("id", F.posexplode(x.chunks(F.col("content"), 400)).alias("pos", "chunk"))


@query("x42_decisions", sql("SELECT id, 'ship three items before yesterday' AS payload, 'decision' AS fact_type FROM memos WHERE priority = '1-URGENT'", MEMOS))
def x42(spark: SparkSession, d: str) -> DataFrame:
    return x.decisions(memos(spark, d)).select("id", "payload", "fact_type")


@query("x44_question_windows", sql("""SELECT id, strftime(day - INTERVAL 27 DAY, '%Y-%m-%d') AS start, strftime(day - INTERVAL 15 DAY, '%Y-%m-%d') AS until
FROM (SELECT id, day - INTERVAL 0 DAY AS day FROM memos)""", MEMOS))
def x44(spark: SparkSession, d: str) -> DataFrame:
    """'Three weeks ago' is 21 days back, give or take a fourth of that, rounded up to days."""
    w = x.question_window(F.lit("what did we ship 21 days ago?"), F.timestamp_millis("observed_at"))
    rows = memos(spark, d).select("id", w.alias("w"))
    return rows.select("id", F.date_format("w.start", "yyyy-MM-dd").alias("start"), F.date_format("w.until", "yyyy-MM-dd").alias("until"))
