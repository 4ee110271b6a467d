"""Licence scans with a positional index of rare words, in DataFrame functions.

Licence notices are short templates of words. Their words, common ones left
out, form the vocabulary; its postings say at which place of which template a
word stands. A first pass splits every text into words and keeps the places of
vocabulary words; document frequencies over the whole corpus give their IDF.
Each file then looks up those of its words that are among the ``RAREST`` of a
template by IDF, so that no notice pushes out another; a posting at place p of a template and a hit at place q vote for
the template at q - p. An alignment
with enough different words is a candidate, and counts only if one of the
template's mandatory phrases stands in the text within the aligned stretch.

Base labels come from three phrases and always stay. The score is the largest
share of a verified template's IDF that its alignment covers, and at least 1/2
where a base phrase stands.

Edge cases: a null or empty text has no words, empty labels and score 0;
overlapping places all count; repeated rows get equal results; ties do not
matter, since every alignment that passes counts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import let, staged

#: What separates words once A-Z is lower-case, and a word before that.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of well-known licence notices, and phrases one of which each must hold.
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", ["affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2"]),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that",
        ["redistribution and use in source and binary forms"],
    ),
    "cc-by-4.0": ("licensed under creative commons attribution cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ["general public license version 2"]),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ["general public license version 3"]),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is granted",
        ["permission to use copy modify and or distribute"],
    ),
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ["permission is hereby granted free of charge"],
    ),
    "mpl-2.0": ("subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered"]),
}
COMMON = set("a and any are by for in into is of or out per that the this to use with".split())
LEAST_WORDS, SLACK = 2, 4
#: Words of a template that vote for it: those of the highest IDF.
RAREST = 8

PHRASES = sorted({*BASE, *(p for _, ps in TEMPLATES.values() for p in ps)})
POSTINGS = [
    (word, name, at)
    for name, (text, _) in TEMPLATES.items()
    for at, word in enumerate(text.split())
    if word not in COMMON and not word.isdigit()
]
VOCABULARY = sorted({w for w, _, _ in POSTINGS})


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column, at: Column, phrase: str) -> Column:
    """Those of the places ``at`` where the phrase's words stand in a row."""
    parts = phrase.split()
    same = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(at, lambda i: F.coalesce(same(i), F.lit(False)))


def _around(offset: int) -> Callable[[Column], Column]:
    """Starts that a phrase at a place vouches for, given its place in the template."""
    return lambda place: F.sequence(place - offset - SLACK, place - offset + SLACK)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places map<phrase, places>, hits (place, word).

    Texts without any vocabulary word of a mandatory phrase skip the search.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = _words(text)
    firsts = sorted({w for p in PHRASES for w in p.split()[:1]})
    # every phrase has one of these words, so a text without them has no phrase
    telling = "(?i)licen[sc]e|redistribution|permission|unencumbered|(?<![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])cc(?![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])"

    def found(w: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(w) - 1)
        at = lambda values: F.filter(index, lambda i: F.array_contains(_strings(values), F.get(w, i)))
        places = lambda a: F.map_from_arrays(_strings(PHRASES), F.array(*[_places(w, a, p) for p in PHRASES]))
        hits = F.transform(at(VOCABULARY), lambda i: F.struct(i.alias("at"), F.get(w, i).alias("word")))
        return F.when(F.size(w) > 0, F.struct(let(at(firsts), places).alias("places"), hits.alias("hits")))

    return docs.select(
        "doc_id",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(text.rlike(telling), let(words, found)).alias("f"),
    ).select("doc_id", "n_words", "f.places", "f.hits")


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, GAPS, -1), "")


def _idf(docs: DataFrame) -> dict[str, float]:
    """IDF of the vocabulary, a fixed number of words, over all documents."""
    own = F.array_intersect(_words(F.coalesce(F.col("text"), F.lit(""))), _strings(VOCABULARY))
    seen = docs.select(F.explode(own).alias("word"))
    df = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    # rounded so that any engine agrees
    return {w: round(math.log((n + 1) / (df.get(w, 0) + 0.5)), 6) for w in VOCABULARY}


def rarest(idf: dict[str, float]) -> dict[str, set[str]]:
    """The words of each template that vote for it."""
    own = {name: sorted({w for w, t, _ in POSTINGS if t == name}) for name in TEMPLATES}
    return {name: set(sorted(words, key=lambda w: (-idf[w], w))[:RAREST]) for name, words in own.items()}


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scanned = staged(scan(docs), "licenses")
    idf = _idf(docs)
    weight = F.create_map(*[F.lit(x) for w in VOCABULARY for x in (w, idf[w])])
    rare = rarest(idf)
    postings = F.array(
        *[F.struct(F.lit(w).alias("word"), F.lit(t).alias("t"), F.lit(p).alias("p")) for w, t, p in POSTINGS if w in rare[t]]
    )

    def candidates(hits: Column) -> Column:
        """(template, start, word) votes of the file's words that are rare in a template."""
        one = lambda h: F.transform(
            F.filter(postings, lambda p: p["word"] == h["word"]),
            lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["p"]).alias("start"), h["word"].alias("word")),
        )
        return F.flatten(F.transform(hits, one))

    def best_share(name: str, votes: Column) -> Column:
        """Largest IDF share of a verified alignment with one template.

        Each place of a mandatory phrase vouches for the starts around the one
        it implies, as a vote with an empty word; sorted, it comes before the
        words of its start, and equal votes meet, so that one pass is enough.
        """
        text, phrases = TEMPLATES[name]
        parts = text.split()
        total = max(sum(idf[w] for w in rare[name]), 1e-9)
        mine = F.transform(F.filter(votes, lambda v: v["t"] == name), lambda v: v.dropFields("t"))
        vouched = []
        for phrase in phrases:
            q = phrase.split()
            at = next(i for i in range(len(parts)) if parts[i : i + len(q)] == q)
            vouched.append(F.flatten(F.transform(F.col("places")[phrase], _around(at))))
        marks = F.transform(F.concat(*vouched), lambda i: F.struct(i.alias("start"), F.lit("").alias("word")))
        zero = F.struct(
            F.lit(None).cast("int").alias("start"), F.lit("").alias("word"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"),
            F.lit(False).alias("sure"), F.lit(0.0).alias("best"),
        )

        def step(a: Column, x: Column) -> Column:
            same = F.coalesce(a["start"] == x["start"], F.lit(False))
            again = same & (a["word"] == x["word"])  # equal votes stand next to each other
            total_idf = F.when(same, a["sum"]).otherwise(0.0) + F.coalesce(F.try_element_at(weight, x["word"]), F.lit(0.0))
            n = F.when(same, a["n"]).otherwise(0) + F.when(x["word"] == "", 0).otherwise(1)
            sure = (same & a["sure"]) | (x["word"] == "")
            now = F.when(sure & (n >= LEAST_WORDS), F.least(F.lit(1.0), total_idf / total)).otherwise(0.0)
            moved = F.struct(
                x["start"].alias("start"), x["word"].alias("word"), total_idf.alias("sum"), n.alias("n"), sure.alias("sure"),
                F.greatest(a["best"], now).alias("best"),
            )
            return F.when(again, a).otherwise(moved)

        ordered = F.sort_array(F.concat(mine, marks))
        return F.aggregate(ordered, zero, step, lambda a: a["best"])

    def verified(votes: Column) -> Column:
        found = [F.struct(F.lit(t).alias("t"), best_share(t, votes).alias("score")) for t in TEMPLATES]
        return F.filter(F.array(*found), lambda x: x["score"] > 0)

    empty = F.array().cast("array<struct<t:string,score:double>>")
    method = F.coalesce(let(candidates(F.col("hits")), verified), empty)
    base = F.coalesce(F.sort_array(F.flatten(F.array(*[F.col("places")[p] for p in BASE]))), F.array().cast("array<int>"))
    base_labels = F.filter(
        F.array(*[F.when(F.coalesce(F.size(F.col("places")[p]), F.lit(0)) > 0, F.lit(v)) for p, v in BASE.items()]),
        lambda x: x.isNotNull(),
    )
    rows = scanned.withColumns({"__base": base, "__labels": base_labels, "__found": method})
    names = F.transform("__found", lambda x: x["t"])
    best = F.coalesce(F.array_max(F.transform("__found", lambda x: x["score"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("__base").cast("long").alias("n_base"),
        F.array_min("__base").cast("long").alias("first_word"),
        F.array_max("__base").cast("long").alias("last_word"),
        F.array_join(F.sort_array("__labels"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("__labels", names))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("__base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
