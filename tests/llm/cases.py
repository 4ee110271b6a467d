"""Awkward documents that every operator and stage must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, kept int, score string"
LONG = "zebra wandered home again " * 30_000


def documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    good = [f"this is plain document number {i} with words like {' '.join(chr(97 + (i * j) % 26) * 4 for j in range(1, 70))}" for i in range(40)]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t)) for i, t in enumerate(good)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \n\t ", "de", None, 4), (103, LONG, "en", "s1", len(LONG))]
    rows += [(104, good[3], "en", "s3", 1), (105, good[3], None, "s0", 1), (3, good[3], "en", "s3", len(good[3]))]
    rows += [(106, "### $$$ %%% " * 40, "en", "s2", 1), (107, "你好 世界 ça va", "zz", "s2", 1), (None, "no id at all", "en", "s1", 1)]
    return spark.createDataFrame([(*r, "x", "y", 7, "z") for r in rows], DOCS)


def labels(spark):
    rows = [(i, 1 if i < 100 else 0, 0, "clash") for i in [*range(40), 100, 101, 106]] + [(None, 1, 0, ""), (5, None, None, "")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def nothing(df):
    return df.where("false")
