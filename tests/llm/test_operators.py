"""The ten operators against brute force, on awkward and on the driver's tables."""

import bisect
import collections
import gzip
import hashlib
import re
import types
import zipfile
import zlib

import cases
import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm import ann, langid, licenses, mil, mixing, packing, queries, rules, simhash, urls, warc
from factlake.operators.graph import components

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^ \t-\r]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return cases.labels(spark).cache()


def read(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet")


# ---- 1 ------------------------------------------------------------------------


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by filling up source after source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rate = (total - sum(most * sizes[s] for s in full)) / max(1e-12, sum(w[s] for s in open_))
        over = {s for s in open_ if w[s] * rate >= most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else w[s] * rate for s in names}
        full |= over


def check_mix(rows, texts):
    sizes = collections.Counter()
    for r, (text, source) in zip(rows, texts, strict=True):
        assert r.size == len(WORD.findall(text or ""))
        sizes[source] += r.size
    want, taken = filled(dict(sizes)), collections.Counter()
    for r, (_, source) in zip(rows, texts, strict=True):
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken <= 3 * r.size
        taken[source] += r.taken
    return want, taken


def test_mixing(spark, docs):
    for df in (docs, read(spark, "documents")):
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size)
        got = sorted(mixing.mix(df).collect(), key=key)
        source = {r.doc_id: (r.text, r.source) for r in df.collect()}
        want, taken = check_mix(got, [source[r.doc_id] for r in got])
        largest = max((r.size for r in got), default=0)
        assert all(abs(taken[s] - want[s]) <= largest for s in want)
        assert [r.taken for r in got] == [r.taken for r in sorted(mixing.mix(df).collect(), key=key)]


def test_mixing_comes_near_on_many_documents(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.002 * r.target for r in got)


def test_mixing_draws_with_unequal_probabilities(spark):
    """Shares taken over many documents come to the inclusion probabilities of each size."""
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 3 == 1, 40).otherwise(700)).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    got = mixing.mix(df).groupBy("source", "size").agg(F.avg("copies").alias("copies"), F.avg("inclusion").alias("p"), F.min("copies").alias("lo")).collect()
    assert len({round(r.p, 6) for r in got if r.source == "s1"}) == 3
    for r in got:
        assert abs(r.copies - r.lo - (r.p if r.lo == int(r.copies - r.p + 1e-3) else r.p)) < 0.04 or r.copies == 3


def test_mixing_splits_a_class_of_equal_rows(spark):
    """Equal rows, with and without an id, have ranks of their own; texts are repeated as the plan says."""
    row = "doc_id long, text string, source string"
    df = spark.createDataFrame([(None, "a b c", "x")] * 25_000 + [(7, "d e", "x")] * 3000 + [(7, "other words", "x"), (None, "z", "x"), (1, "q r s t", "y")], row)
    got = mixing.mix(df)
    sums = {r.source: (r.taken, r.target) for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert got.count() == 28_003 and all(abs(a - b) <= 4 for a, b in sums.values())
    want = {r.doc_id: r.n for r in got.where("size > 0").groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n}
    mixed = {r.doc_id: r["count"] for r in mixing.repeat_documents(df).groupBy("doc_id").count().collect()}
    assert mixed == want


def test_mixing_empty(docs):
    assert mixing.mix(cases.nothing(docs)).count() == 0


# ---- 2 ------------------------------------------------------------------------


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    at = {k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


def test_rules_base(spark, docs, labels):
    for df, lab in ((docs, labels), (read(spark, "documents"), read(spark, "labels"))):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = rules.apply_rules(df, lab).collect()
        assert len(got) == df.count()
        for r in got:
            want = base(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)


def test_rules_certify_only_with_enough_labels(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2900, "en").otherwise("fr").alias("lang"),
        F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i * (F.col("id") + 1) % 100003)), " "), F.when(F.col("id") % 10 == 0, F.repeat(F.lit("#"), 200)).otherwise("")).alias("text"),
    )
    lab = df.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    last = {r.stratum: r.last for r in rules.calibrate(rules.statistics(df), lab).collect()}
    strictest = rules.path().index(("symbol_ratio", min(rules.CUTOFFS["symbol_ratio"]))) + 1
    assert last["sen"] >= strictest and last["sfr"] is None
    kept = {(r.doc_id % 10 == 0, r.doc_id < 2900): 0 for r in lab.collect()}
    for r in rules.apply_rules(df, lab).collect():
        kept[r.doc_id % 10 == 0, r.doc_id < 2900] += r.kept
    assert kept == {(True, True): 0, (False, True): 2610, (True, False): 10, (False, False): 90}


def slow_step(values):
    return next((i for i, (rule, cut) in enumerate(rules.path(), 1) if values[rule] > cut), None)


def test_rules_against_a_slow_version(spark):
    """The verdicts of the driver's table, from holdout counts and exact tails in plain Python."""
    import math

    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows, hold = {}, collections.defaultdict(list)
    for r in docs.collect():
        text = r.text or ""
        n, chars, symbols, dup, repeat = base(text)
        lines = len([x for x in text.split("\n") if WORD.search(x)])
        upper = 2 * len(re.findall("[A-ZÀ-ÖØ-Þ]{2}", text))
        over = lambda a, b: a / b if b else 0.0
        step = slow_step({"symbol_ratio": over(symbols, chars), "upper_ratio": over(upper, chars), "dup_line_ratio": over(dup, lines), "repeat_ratio": over(repeat, n), "mean_word_length": over(chars, n)})
        failed = n < 50 or 100 * repeat > 50 * n
        rows[r.doc_id] = (r.lang, failed, step)
        if r.doc_id in good and not failed:
            hold[r.lang].append(step)
    last = {}
    for lang, steps in hold.items():
        for t in range(1, len(rules.path()) + 1):
            k, m = sum(s is not None and s <= t for s in steps), len(steps)
            tail = sum(math.comb(m, i) * rules.RISK**i * (1 - rules.RISK) ** (m - i) for i in range(k + 1))
            if tail > rules.LEVEL / len(hold):
                break
            last[lang] = t
    want = {i: not failed and not (step is not None and step <= last.get(lang, 0)) for i, (lang, failed, step) in rows.items()}
    assert set(last) == set(hold) and {r.doc_id: r.kept for r in rules.apply_rules(docs, labels).collect()} == want


def test_binomial_bound_is_exact(spark):
    import math

    rows = [(0, 300), (3, 300), (10, 5000), (0, 1), (5, 5)]
    df = spark.createDataFrame(rows, "k long, n long").select(rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for (k, n), r in zip(rows, df.collect(), strict=True):
        exact = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k <= n * 0.01 or k < 5 else 1.0
        assert r.p == pytest.approx(exact, rel=1e-6) or r.p == 1.0


def test_rules_have_no_python(docs, labels):
    plan = rules.keep_good(docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 3 ------------------------------------------------------------------------


def nearest(ids, x, k):
    out = {}
    for i in [j for j, v in enumerate(ids) if v % 100 == 0]:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[ids[i]] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[100:400] = x[100]  # copies, one of them a query
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [None] * 8), (2400, [float("inf")] + [1.0] * 7), (2500, [1.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, v string")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = nearest(np.arange(1500), x.astype(float), 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 14)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [v for _, v, _ in got[200]] == list(range(100, 110))


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ann.search(cases.nothing(df), F.col("vec_id") == 0).count() == 0


# ---- 4 ------------------------------------------------------------------------


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (docs, read(spark, "documents").limit(80)):
        df = df.cache()
        got = packing.pack_documents(df).collect()
        want = collections.Counter()
        for r in df.collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                want[r.doc_id, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        by = collections.defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            ends = 0
            for offset, length in sorted(parts):
                assert offset == ends
                ends += length
            assert ends <= 2048
        assert len(by) <= 1.05 * sum(r.length for r in got) / 2048 + 1
    assert packing.pack_documents(cases.nothing(docs)).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    df = read(spark, "documents").limit(30).cache()
    total = packing.pack_documents(df).agg(F.sum("length")).first()[0]
    rows = packing.sequences(df).collect()
    assert sum(len(r.ids) for r in rows) == total and max(len(r.ids) for r in rows) <= 2048
    assert sum(r.ids.count(0) for r in rows) >= 30


@pytest.mark.parametrize("text", ["don't STOP it's \x1c x\x1dy \xa0z", "ÉÀß ẞ İstanbul K é ä.", "<|endoftext|> a<|startoftext|>b", "日本語 テスト... 123 4.5", "  ", "a\u3000b\x85c", "Σίσυφος ΣΑΣ", "x" * 5000])
def test_word_ids_equal_the_tokenizer(text):
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.whole.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_once_for_all_cases_and_marks():
    """The tokenizer's merges run for each run of letters and each run of marks, not for each word that they make."""
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    model, calls = words.model, []
    words.model = types.SimpleNamespace(tokenize=lambda part: calls.append(part) or model.tokenize(part))
    stems, marks = [f"{a}nder{b}éble" for a in "bdfgh" for b in "lmnrst"], ["", ".", ",", "?!", "##"]
    text = " ".join(form(s) + m for s in stems for m in marks for form in (str.lower, str.title, str.upper))
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.whole.encode(text, add_special_tokens=False).ids
    assert len(calls) <= len(stems) + len(marks)


def test_ids_of_many_texts(monkeypatch):
    """Texts over several cuts and generations of remembered words, from a slice of an array."""
    monkeypatch.setattr(packing, "SOME_BYTES", 300)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    rng = np.random.default_rng(4)
    signs = list("aAbZéÉß×÷ŸÀ.,!?;:|#$%&*'’- \t\n\x1c\x85\xa0\u3000\u0301İ\u212aẞΣσ日가½ª19_\x00😀") + ["<|endoftext|>", "'s", " the"] * 3
    texts = [None, "", " ", *("".join(rng.choice(signs, n)) for n in rng.integers(0, 60, 1500)), "word " * 500, None]
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    got = list(words.of_texts(pa.array(["left out", *texts])[1:]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [words.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(words.of_texts(pa.array([], pa.string()))) == []


def plain_best_fit(lengths, capacity):
    """Sequences that one global best fit, longest first, opens."""
    free = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        gap = free.pop(i) if i < len(free) else capacity
        bisect.insort(free, gap - n)
    return len(free)


SHAPES = {
    "short": lambda r: r.integers(3, 120, 6000), "middling": lambda r: r.integers(500, 900, 1500), "long": lambda r: r.integers(600, 2049, 1500),
    "mixed": lambda r: np.minimum(2048, r.exponential(300, 6000).astype(int) + 1), "equal": lambda r: np.full(5000, 700), "ones": lambda r: np.ones(5000, int),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_packing_comes_to_plain_best_fit(spark, shape):
    lengths = SHAPES[shape](np.random.default_rng(1))
    df = spark.createDataFrame([(i // 2, 0, 0, int(n), 5) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df).collect()
    assert collections.Counter((r.doc_id, r.length) for r in got) == collections.Counter((i // 2, int(n)) for i, n in enumerate(lengths))
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) <= 1.01 * plain_best_fit(lengths.tolist(), 2048) + 1


def test_supersteps_stay_few_as_pieces_grow():
    rng = np.random.default_rng(2)
    for n in (3000, 30_000, 300_000):
        lengths = collections.Counter(np.minimum(2048, rng.exponential(700, n).astype(int) + 1).tolist())
        placed, gaps, opened, steps = {}, {}, 0, 0
        while sum(placed.values()) < n:
            fresh = packing.to_open(lengths, placed, gaps, 2048)
            opened, steps = opened + fresh, steps + 1
            gaps[2048] = gaps.get(2048, 0) + fresh
            flows, gaps = packing.sweep(lengths, placed, gaps)
            assert len(flows) < 10_000
        assert steps <= 30 and opened <= 1.01 * sum(k * v for k, v in lengths.items()) / 2048 + 1


# ---- 5 and 6 ---------------------------------------------------------------------


def test_language_id(spark, docs):
    truth = {r.doc_id: r.lang for r in read(spark, "documents").collect()}
    got = [r for r in langid.identify(read(spark, "documents")).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.95
    odd = langid.identify(docs).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {100, 101, 102, 106}
    assert langid.identify(cases.nothing(docs)).count() == 0


def test_many_languages(spark, monkeypatch):
    """Labels beyond the bound are not learned; those with most rows are."""
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    rows = [(i, f"{'abc' if i % 2 else 'xyz'} words number {i}", "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100 + i, "some other text", f"dirty{i}") for i in range(30)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} <= {"aa", "bb"} and len(got) == 90


def test_language_id_against_a_slow_version(spark):
    """Counts, priors and posteriors of naive Bayes, gram by gram."""
    import math

    rows = [(1, "the cat", "en"), (2, "a dog ran", "en"), (3, "le chat", "fr"), (4, "un chien", "fr"), (5, "the end", "en"), (6, "!!", "fr"), (7, "le", None), (8, "chat the", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = lambda i: zlib.crc32(str(i).encode()) % 4 != 2

    def buckets(text):
        low, out = text.lower() + "  ", []
        for i in range(len(low) - 2):
            if low[i].isalpha():
                cps = np.array([ord(x) for x in low[i : i + 3]] + [32, 32], np.uint32)
                out += langid.grams(cps[:3], langid.letter_table())[:1].ravel().tolist()
        return out

    counts, docs_of = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang in rows:
        if lang and learn(i):
            counts[lang].update(buckets(text))
            docs_of[lang] += 1
    total = {x: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for x, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, text, _ in rows:
        logs = {x: math.log(docs_of[x] / sum(docs_of.values())) + sum(math.log((counts[x][b] + langid.SMOOTHING) / total[x]) for b in buckets(text)) for x in counts}
        best = max(sorted(logs), key=logs.get)
        score = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert (got[i].lang_pred, got[i].held_out) == ("und" if i == 6 else best, not learn(i))
        assert got[i].score == pytest.approx(0.0 if i == 6 else score, rel=1e-4)


def test_language_blocks_cut_long_texts_without_a_seam():
    text = "le chat dort. " * 40_000
    whole = langid.grams(langid._code_points(text.lower() + "  "), langid.letter_table())
    parts = np.concatenate([found for _, found in langid.blocks([text])])
    assert len(parts) == len(whole) and (np.bincount(parts.ravel()) == np.bincount(whole.ravel())).all()


def test_quality_classifier(spark, docs, labels):
    good = {r.doc_id: r.quality for r in read(spark, "labels").collect()}
    got = mil.classify(read(spark, "documents"), read(spark, "labels")).collect()
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == good[r.doc_id] for r in held]) > 0.85
    odd = mil.classify(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert mil.classify(docs, cases.nothing(labels)).first().score == 0.5
    assert mil.classify(cases.nothing(docs), labels).count() == 0


def test_passages_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    texts = ["one two three. " * 300, "", None, "x" * 5000, "Ab cd! " * 700]
    whole, counts = mil.encode(texts)
    monkeypatch.setattr(mil, "BLOCK", 2 * mil.PASSAGE)
    parts, again = mil.encode(texts)
    assert counts.tolist() == again.tolist() == [max(1, -(-len(t or "") // mil.PASSAGE)) for t in texts]
    assert np.allclose(whole, parts)


def test_training_sees_every_passage_of_a_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mil.Attention, "fit", lambda self, x, counts, y: seen.extend(counts) or self)
    docs = spark.createDataFrame([(1, "w " * 60_000), (2, "short"), (3, None), (1, "w " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    mil.train(docs, labels, F.lit(True))
    assert sorted(seen) == [1, 1, 200]


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(9, mil.N_FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    model = mil.Attention(0.5)
    h, g = mil.HIDDEN, mil.GATE
    model.params = [rng.normal(size=s) * 0.3 for s in ((mil.N_FEATURES, h), (h,), (h, g), (h, g), (g,), (h,), (1,))]
    starts = np.cumsum(counts) - counts

    def loss():
        p = model._forward(x, starts, counts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for p, grad in zip(model.params, model._gradients(x, counts, y), strict=True):
        at = tuple(0 for _ in p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert np.asarray(grad)[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# ---- 7 ------------------------------------------------------------------------


def test_urls_against_sql(spark):
    con = oracle.connect(SF)
    assert oracle.difference(queries.op7_url_filters(spark, SF), con, urls.oracle()) is None


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("http://", ("", "", None, "allow")),
        ("x://A.Example.ORG/es/1?q=://y", ("a.example.org", "/es/1", "example.org/es/", "block")),
        ("x://example.org/es", ("example.org", "/es", "org/", "allow")), ("x://org#/f", ("org", "", None, "allow")),
        ("x://example.org/en/19", ("example.org", "/en/19", "example.org/en/1", "block")),
        ("x://b.com/de/?x", ("b.com", "/de/", "com/de/", "block")), ("x://notexample.net/", ("notexample.net", "/", None, "allow")),
        ("x://m.spam-farm.example.net/a", ("m.spam-farm.example.net", "/a", None, "block")),
        ("x://spam-farm.example.org/a", ("spam-farm.example.org", "/a", "org/", "allow")),
    ],
)
def test_urls(spark, url, want):
    pages = spark.createDataFrame([(1, url, "h"), (1, url, "h"), (None, None, None)], "page_id long, url string, host string")
    got = urls.filter_urls(pages, urls.entries(spark, urls.RULES, urls.BLOCKED_HOSTS)).where("page_id = 1").collect()
    assert [tuple(r)[1:] for r in got] == [want, want]


def test_a_digest_collision_does_not_decide():
    part = urls._Part.__new__(urls._Part)
    d = xxhash.xxh64_intdigest(b"b.com", 42)
    part.digests, part.offsets = np.array([d, d], np.uint64), np.array([0, 5, 10])
    part.verdicts, part.strings = np.array([2, 1]), np.frombuffer(b"a.comb.com", np.uint8)
    keys = [b"b.com", b"c.com"]
    assert part.find(keys, np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)).tolist() == [1, -1]


def test_hosts_come_from_a_table_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(urls, "ENTRIES_PER_PART", 300)
    hosts = spark.range(2000).select(F.concat(F.lit("H"), "id", F.lit(".net")).alias("host"), F.lit(1).alias("entry"))
    table = urls.entries(spark, [("allow", "h7.net/ok")], hosts)
    assert len(urls.build(table)) > 4
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.h"), "id", F.lit(".net/ok")).alias("url"))
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, table).collect()}
    assert got == {i: "block" if i < 2000 and i != 7 else "allow" for i in range(3000)}


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages, urls.entries(spark, urls.RULES, [])).count() == 0
    one = spark.createDataFrame([(1, "x://a.com/de/")], "page_id long, url string")
    assert urls.filter_urls(one, cases.nothing(urls.entries(spark, urls.RULES, []))).first().verdict == "allow"


# ---- 8 ------------------------------------------------------------------------


def license_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    at, found = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        found |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"), ("x Licensed under the Apache License, Version 2.0. y", "apache,apache-2.0"),
        ("licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("mit license mit license", "mit"), ("the apache helicopter needs a license", ""), ("cc by 4 0", ""), (None, ""), ("", ""), ("éMIT License", ""),
    ],
)
def test_licenses(spark, text, labels):
    noise = [(2, "license " * 3000), (3, "plain text"), (4, None)]
    df = spark.createDataFrame([(1, text, 5), *[(i, t, 5) for i, t in noise]], "doc_id long, text string, labels int")
    got = {r.doc_id: r for r in licenses.licenses(df).collect()}
    r = got[1]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_base(text)
    assert r.labels == labels and 0 <= r.score <= 1
    assert got[2].labels == got[3].labels == got[4].labels == ""


def test_licenses_on_tables(spark, docs):
    for df in (docs, read(spark, "documents")):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in licenses.licenses(df).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_base(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.licenses(cases.nothing(docs)).count() == 0


# ---- 9 ------------------------------------------------------------------------


def test_warc(spark):
    big, other = "<p>é" + "x" * 1500, "y" * 999
    rows = [(1, "http://a/1\r\nX: y", big), (2, "http://a/2", big), (7, None, big), (7, "http://a/7", big), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", ""), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").na.fill({"page_id": -1, "refers_to": -1}).collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 7
        want.append((-1 if i is None else i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 7 if revisit else -1))
    assert got == sorted(want)
    assert warc.round_trip(cases.nothing(pages)).count() == 0


def test_warc_against_sql(spark):
    con = oracle.connect(SF)
    assert oracle.difference(queries.op9_warc(spark, SF), con, warc.oracle()) is None


def test_packages_are_zip_files(spark):
    pages = read(spark, "pages")
    packages = [r.package for r in warc.write(pages).collect()]
    n = 0
    for uri in packages:
        with zipfile.ZipFile(uri.removeprefix("file://")) as z:
            assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
            n += gzip.decompress(z.read(warc.DATA)).count(b"WARC/1.1\r\n")
    assert n == pages.count()


def test_reader_takes_archives_without_zip64(tmp_path):
    import pyarrow as pa

    path = tmp_path / "plain.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"first")
        z.writestr("b/c", b"second")
        z.comment = b"a comment"
    with pa.OSFile(str(path)) as f:
        assert {k: f.read_at(n, at) for k, (at, n) in warc.members(f, f.size()).items()} == {"a": b"first", "b/c": b"second"}


# ---- 10 -----------------------------------------------------------------------


def slow_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, ids):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.nonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)[0]:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    low = collections.defaultdict(list)
    for i, d in enumerate(ids):
        low[root(i)].append(d)
    return [min((d for d in low[root(i)] if d is not None), default=None) for i in range(len(x))]


def test_simhash(spark, docs):
    for df in (docs, read(spark, "documents")):
        rows = df.collect()
        fps = [slow_fingerprint(r.text) for r in rows]
        want = collections.Counter(zip([r.doc_id for r in rows], fps, linked(fps, [r.doc_id for r in rows]), strict=True))
        got = simhash.near_duplicates(df).collect()
        assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(cases.nothing(docs)).count() == 0


def test_simhash_with_ids_at_both_ends(spark):
    """Rows without an id next to the smallest and largest ids; classes without one stay apart."""
    low, high = -(2**63), 2**63 - 1
    rows = [(high, "same text here again"), (low, "another text altogether"), (None, "no id at all"), (None, "nor here, sadly, is one"), (None, "same text here again"), (high - 1, "same text here again")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(high, high - 1), (low, low), (None, None), (None, high - 1), (high - 1, high - 1)}
    assert len(got) == 6 and {(r.doc_id, r.component_id) for r in got} == want


def test_links_of_dense_groups(spark, monkeypatch):
    """Random points, balls and chains, with more points than a leaf holds."""
    rng = np.random.default_rng(3)
    base_points = rng.integers(0, 2**63, 900, dtype=np.uint64)
    ball = [int(base_points[0]) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (500, 2)) if a != b]
    chain = [int(base_points[1])]
    for i in range(60):
        chain.append(chain[-1] ^ (1 << i))
    fps = list(dict.fromkeys([*map(int, base_points), *ball, *chain]))
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "node long, fp long")
    want = linked(fps, list(range(len(fps))))
    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want
    # the same with a deep tree, and with shards that are dealt in blocks
    for name, value in (("SHARD", 20), ("BLOCK", 30), ("QUERIES", 15)):
        monkeypatch.setattr(simhash, name, value)
        got = {r.node: r.component for r in components(simhash.links(df)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_shards_stay_flat():
    """The largest share of classes in one shard, at ten times the classes."""
    rng = np.random.default_rng(5)
    for n in (20_000, 200_000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        nodes = simhash.build_tree(x[: max(simhash.SAMPLE, 4 << simhash.depth_for(n))], simhash.depth_for(n))
        assert np.bincount(simhash.route(nodes, x, 0)[1]).max() < 3 * simhash.SHARD


def test_small_helpers():
    assert simhash.fingerprint("A b C") == xxhash.xxh64_intdigest(b"a b c", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


# ---- registry -------------------------------------------------------------------


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
