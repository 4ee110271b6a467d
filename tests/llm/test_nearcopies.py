"""The near-copy stage against all pairs of shingle sets."""

import collections

import corpus_pipeline as p
import numpy as np

from factlake.llm import nearcopies

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def survivors(rows):
    """One row of each component of pairs at similarity 0.8, smallest id first, nulls last."""
    sets, up = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return collections.Counter(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in groups.values())


def kept(spark, rows):
    out = dict(p.STAGES)["near duplicates"](spark, spark.createDataFrame(rows, SCHEMA), "")
    return out.collect()


def test_near_copies_at_the_border(spark):
    rng, rows = np.random.default_rng(4), []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 4):  # 1 to 6 words changed: similarity 0.95 to 0.7
            copy = list(base)
            for at in rng.integers(5, 195, int(rng.integers(1, 7))):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((10 * g + c, " ".join(copy)))
    got = kept(spark, rows)
    assert collections.Counter((False, r.doc_id) for r in got) == survivors(rows)


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert collections.Counter((False, r.doc_id) for r in kept(spark, rows)) == survivors(rows)


def test_rows_are_known_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # id 5 heads one group and is a member of another; id 7 has two texts; ids may be null
    rows = [(5, a), (6, a), (1, b), (5, b), (7, c), (7, "quite another text of seven words"), (7, c), (None, "one"), (None, "two"), (None, "two"), (None, c)]
    got = kept(spark, rows)
    want = [(1, b), (5, a), (7, c), (7, rows[5][1]), (None, "one"), (None, "two")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def star(rng, n, words=200, changed=5):
    """A text and copies of it, each with its own words changed, so that most pairs of copies are unlike."""
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for at in rng.choice(np.arange(5, words - 5), changed, replace=False):
            copy[at] = f"x{rng.integers(0, 10**9)}"
        out.append(" ".join(copy))
    return out


def test_large_bands_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = star(rng, 70, changed=4) + star(rng, 40, changed=7) + star(rng, 40, changed=3)
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    want = survivors(rows)
    monkeypatch.setattr(nearcopies, "BLOCK", 9)
    monkeypatch.setattr(nearcopies, "COLUMNS", 50)
    assert collections.Counter((False, r.doc_id) for r in kept(spark, rows)) == want


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, k)) for k in (0, 5, 30, 200, 7)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets[:2]]
    assert nearcopies.shared_counts(sets[:2], sets).tolist() == want
