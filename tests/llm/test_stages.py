"""Stages of the corpus pipeline on odd rows: nulls, repeated rows, clashing columns, empty tables."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, me string, doc string, score double, _me string"


def rows():
    text = " ".join(f"Wort{i} und word{i % 7}" for i in range(40))
    one = lambda k, t: (k, t, "en", None, "mine", "d", 0.5, "x")
    return [one(1, text), one(1, text), one(2, text + " more"), one(None, text), one(None, None), one(3, None), one(4, ""), one(5, "Only seven words stand in this text.")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows_and_empty_tables(spark, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert stage(spark, docs.limit(0), SF).count() == 0
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "pack":
        assert sorted({r.doc_id for r in got if r.doc_id is not None}) == [1, 2, 3, 4, 5]
        return
    assert out.columns == docs.columns
    assert all((r.me, r.doc, r.score, r._me) == ("mine", "d", 0.5, "x") for r in got)
    left = sorted((r.doc_id for r in got), key=lambda k: (k is None, k or 0))
    want = {"language": [1, 1, 2, 5, None], "similar": [3, 4, 5, None, None]}
    assert left == want.get(name, [1, 1, 2, 3, 4, 5, None, None])
