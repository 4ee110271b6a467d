"""The five stages on awkward documents and on the driver's tables."""

import cases
import corpus_pipeline as p
import pytest

from factlake.llm import mil, mixing, rules

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf_dir(spark, tmp_path):
    cases.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    cases.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize(("name", "stage"), p.STAGES)
def test_stage_takes_awkward_and_no_documents(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stage(spark, docs, sf_dir)
    if stage is not p.best_fit_packing:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {repr(r) for r in out.collect()} <= {repr(r) for r in docs.collect()}
    assert stage(spark, cases.nothing(docs), sf_dir).count() == 0


def test_stages_keep_what_their_operators_decide(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(p.quality_classifier(spark, docs, SF)) == ids(mil.classify(docs, labels).where("predicted = 1"))
    assert ids(p.quality_rules(spark, docs, SF)) == ids(rules.apply_rules(docs, labels).where("kept"))
    mixed = mixing.mix(docs).where("size > 0")
    assert ids(p.source_mix(spark, docs, SF)) == sorted(r.doc_id for r in mixed.collect() for _ in range(r.copies))


def test_run(spark):
    out = p.run(spark, SF)
    fill = out.groupBy("sequence_id").sum("length").collect()
    assert out.count() > 0 and max(r[1] for r in fill) <= 2048
