"""Operators 11 to 13 against scoring every document, both tokenizers, and encoding every prefix."""

import collections
import hashlib
import math
import random
import re

import cases
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm import alignment, queries, tokencounts, wand

SF = "/root/testdata/sf0.001"
PARTS = ["a", "b", "the", "ing", "  ", " ", " ", "\n", "é", "你", "가", "\x01", "\x00", "er", "s", "1", "23", "</s>", "<0x41>", "aaaa", "====", "//"]
PARTS += ["\U0001f600", " t", "ﬁ", "Ａ", "\x1c", "\x85", "\t", "'s", "'ll", "<|endoftext|>", "​", "\r\n", " \n", "﻿", "é", ".", ",", "&&", "#"]


def awkward(n, extra=()):
    rng = random.Random(3)
    return ["".join(rng.choice([*PARTS, *(extra if i % 20 == 0 else ())]) for _ in range(rng.randint(0, 40))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def mixed(spark, docs):
    """The awkward table, the driver's documents, and texts of odd characters."""
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(awkward(600, ["▁", "▁▁"]))], "doc_id long, text string")
    own = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.unionByName(own, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True).cache()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


# ---- 11 -----------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def best(docs, items, k=10):
    words = [(d, collections.Counter(terms(t))) for d, t in docs]
    words = [(d, w, sum(w.values())) for d, w in words if w]
    n_docs, length = len(words), sum(n for *_, n in words)
    df = collections.Counter(t for _, w, _ in words for t in w)
    out = []
    for item, text in items:
        scored = []
        for d, w, n in words:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in terms(text) if t in w)
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=order)


def found(docs, items, **options):
    return sorted(map(tuple, wand.search(docs, items, **options).collect()), key=order)


ITEMS = [(1, "Plain document number 3 zebra"), (2, ""), (3, None), (None, "wandered home HOME home"), (1, "words like bbbb bbbb"), (4, "nosuchterm"), (5, "你好 ça va"), (6, "id at all")]


def test_search(spark, docs, mixed, monkeypatch):
    items = spark.createDataFrame([(*r, "clash") for r in ITEMS], "item_id long, text string, doc_id string")
    passages = spark.read.parquet(f"{SF}/benchmark.parquet")
    passages = [(r.item_id, r.text) for r in passages.collect()]
    for df in (docs, mixed):
        want = best(rows_of(df), ITEMS)
        assert found(df, items) == want
    both = spark.createDataFrame(ITEMS + passages, "item_id long, text string")
    want = best(rows_of(mixed), ITEMS + passages)
    assert found(mixed, both) == want
    # blocks of few queries; more and smaller shards
    monkeypatch.setattr(wand, "BLOCK_TERMS", 300)
    assert found(mixed, both) == want
    assert found(mixed.repartition(13), both, k=3) == best(rows_of(mixed), ITEMS + passages, 3)


def test_search_of_copies_and_ties(spark):
    """Thousands of equal documents: those with the smallest ids win."""
    rows = [(i * 7 % 3001, "same words stand here again") for i in range(3000)] + [(9_000, "other words"), (None, "same words stand here again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(0, "words stand"), (1, "other"), (2, "again again same")]
    assert found(df, spark.createDataFrame(items, "item_id long, text string")) == best(rows, items)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(cases.nothing(docs), items) == found(docs, cases.nothing(items)) == []
    assert found(docs.withColumn("text", F.lit(None).cast("string")), items) == []


def test_skipping():
    """Documents that cannot enter the heap are passed over, not scored."""
    import numpy as np
    import pyarrow as pa

    n = 20_000
    common, rare = [1] * n, [i % 1000 == 0 for i in range(n)]
    lists = [[0, 1] if r else [0] for r in rare]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([50] * n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array([common[: len(x)] for x in lists], pa.list_(pa.int32()))],
        names=["doc_id", "n", "terms", "tfs"],
    )
    shard = wand.Shard([batch], np.array([1, 9000]), n, 50 * n)

    class Counted(type(shard.gains)):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    shard.gains = Counted("q", shard.gains)
    assert [-p for _, p in sorted((s, -p) for s, p in shard.best({0: 1, 1: 1}, 10))][::-1] == [i * 1000 for i in range(10)]
    assert Counted.reads < 13_000  # after the tenth, only the rare term's documents


# ---- 12 -----------------------------------------------------------------------


def linked(rows):
    """Groups and links from the sets of byte ends of both sides' tokens."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    out, count = [], collections.Counter()
    for doc_id, text in rows:
        ends = [{}, {}]
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            sides = [[(i, bytes(stands[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]]
            names = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            sides += [[(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in names]]
            if all(b"".join(x for _, x in side) == (" " + text).encode() for side in sides):
                for side, at in zip(sides, ends, strict=True):
                    n = 0
                    for i, x in side:
                        n += len(x)
                        at[n] = i
        shared, groups, low = sorted(ends[0].keys() & ends[1].keys()), [], 0
        for cut in shared:
            groups.append("|".join(",".join(str(i) for n, i in at.items() if low < n <= cut) for at in ends))
            low = cut
        links = [(ends[0][n], ends[1][n]) for n in shared]
        count.update(links)
        out.append((doc_id, len(ends[0]), len(ends[1]), links, ";".join(groups)))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    rows = []
    for doc_id, n_a, n_b, links, groups in out:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        rows.append((doc_id, n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(rows, key=order)


def test_alignment(mixed):
    small = mixed.where("length(text) < 20000 OR text IS NULL")
    want = linked(rows_of(small))
    assert sum(r[1] == 0 for r in want) > 20
    for most in (10**6, 0):  # the pair table sent to tasks, and joined
        assert sorted(map(tuple, alignment.align_documents(small, most_pairs=most).collect()), key=order) == want


def test_alignment_of_long_and_no_texts(spark, docs, monkeypatch):
    rows = [(1, "x" * 60_000), (2, "你好" * 20_000), (3, " " * 5_000), (4, "ab " * 9_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align_documents(df).collect()}
    assert all(got[i].n_a > 0 and got[i].n_links > 0 for i in got) and len(got) == 4
    assert alignment.align_documents(cases.nothing(docs)).collect() == []
    groups = alignment.align(docs, with_groups=True).where("doc_id = 107").first()
    assert hashlib.sha256(groups.groups.encode()).hexdigest() == groups.groups_sha256


def test_bitset():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        ends = np.unique(rng.integers(1, size + 1, size // 2 + 1))
        held = alignment.Bitset(ends, size)
        at = np.arange(size)
        assert held.rank(at).tolist() == [int((ends - 1 <= i).sum()) for i in at]
        other = np.unique(rng.integers(1, size + 1, size // 2 + 1))
        assert alignment.cuts(held, alignment.Bitset(other, size)).tolist() == sorted({*(ends - 1).tolist()} & {*(other - 1).tolist()})


# ---- 13 -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencounts.MODEL))


def test_counts_of_every_prefix(model):
    held = tokencounts.Prefixes(public_tokenizers.path(tokencounts.MODEL))
    texts = [*awkward(800, ["▁"]), "", " ", "the   end ", "of\nlines\n\n", "x" * 300]
    for text, steps in zip(texts, held.steps(texts), strict=True):
        counts = [0]
        for step in steps:
            counts.append(counts[-1] + (step - 256 if step > 127 else step))
        assert counts == [len(ids) for ids in model.encode([text[:i] for i in range(len(text) + 1)])], text


def test_token_counts(mixed, model, monkeypatch):
    texts = rows_of(mixed)
    want = []
    for doc_id, text in texts:
        n = len(model.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, tokencounts.token_counts(mixed).collect()), key=order) == sorted(want, key=order)
    assert any(over for *_, over in want)


def test_budgets_and_truncation(spark, model, monkeypatch):
    monkeypatch.setattr(tokencounts, "BLOCK", 16)
    texts = [*awkward(120), "", "a" * 16, "the end of it all", "x" * 32]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = tokencounts.prefix_table(df).cache()
    counts = {i: [len(x) for x in model.encode([t[:n] for n in range(len(t) + 1)])] for i, t in enumerate(texts)}
    for asked in (0, 5, 16, 31, 32, 500):
        got = {r.doc_id: (r.chars, r.tokens) for r in tokencounts.tokens_of_prefixes(table, asked).collect()}
        assert got == {i: (min(asked, len(c) - 1), c[min(asked, len(c) - 1)]) for i, c in counts.items()}
        got = {r.doc_id: (r.chars, r.tokens) for r in tokencounts.longest_prefixes(table, asked).collect()}
        fits = {i: max(n for n, x in enumerate(c) if x <= asked) for i, c in counts.items()}
        assert got == {i: (n, counts[i][n]) for i, n in fits.items()}


def test_no_texts(docs):
    assert tokencounts.token_counts(cases.nothing(docs)).collect() == []
    assert tokencounts.prefix_table(cases.nothing(docs)).collect() == []


def test_registered(spark):
    for name in ("op11_lexical_search", "op12_token_alignment", "op13_token_counts"):
        assert queries.QUERIES[name](spark, SF).count() > 0
