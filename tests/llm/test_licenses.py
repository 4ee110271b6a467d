"""License scans: frequencies over every text, and words as the contract separates them."""

import math

import pytest

from factlake.llm import licenses


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_idf_counts_every_text(spark):
    texts = ["released under the MIT license", *["software is free, under general terms"] * 9, None, "Under_software"]
    idf = licenses._idf(frame(spark, texts))
    for word, n in {"software": 10, "under": 11, "general": 9, "license": 1, "mozilla": 0}.items():
        assert idf[word] == pytest.approx(math.log(13 / (n + 0.5)), abs=1e-6)


@pytest.mark.parametrize("text", ["licensed under creative commons attribution CC_BY_4_0", "under creative commons attribution CC_BY_4_0"])
def test_words_end_at_underscores(spark, text):
    got = licenses.licenses(frame(spark, [text, *["plain words"] * 5])).where("doc_id = 0").first()
    assert got.labels == "cc-by-4.0"


def test_no_notice_pushes_out_another(spark):
    text = ". ".join(notice for notice, _ in licenses.TEMPLATES.values())
    got = licenses.licenses(frame(spark, [text, *["plain words"] * 5])).where("doc_id = 0").first()
    assert set(licenses.TEMPLATES) <= set(got.labels.split(",")) and got.score == pytest.approx(1.0)


def test_twenty_thousand_words_of_notices(spark):
    """A text of nothing but notices takes time in proportion to its words."""
    import time

    text = "MIT license " * 10_000
    frame(spark, [text]).transform(licenses.licenses).collect()  # compiles
    began = time.time()
    got = licenses.licenses(frame(spark, [text])).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == (20_000, 10_000, 0, 19_998, "mit")
    assert time.time() - began < 20


def test_rarest_words_vote():
    idf = {w: float(i) for i, w in enumerate(licenses.VOCABULARY)}
    for name, words in licenses.rarest(idf).items():
        own = {w for w, t, _ in licenses.POSTINGS if t == name}
        assert words <= own and len(words) == min(len(own), licenses.RAREST)
        assert min((idf[w] for w in words), default=0) >= max((idf[w] for w in own - words), default=0)
