"""Every stage of the pipeline takes columns of any name, keeps them as they are, and has a result for odd rows and empty tables."""

import pytest

import corpus_pipeline
from loomline.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `x y` string, epoch int, turn string, score double, rank int, `q``t` int"
SAME = "one two three four five six seven eight nine ten eleven twelve"


def rows():
    out = [(i, f"word{i} " * (i % 7) + f"mail a{i}@b.example", "en", f"s{i % 3}", 5, i, "mine", 7, "t", 0.25, i, i) for i in range(30)]
    odd = [(None, None, None, None, None, -1, None, 8, "t", None, -1, -1), (3, "", "en", None, 0, -2, None, 9, "t", None, -1, -1)]
    return out + odd + [(40, SAME, "en", "s0", 1, -3, "", 1, "", 0.0, 1, 1), (41, SAME, "en", "s1", 1, -4, "", 1, "", 0.0, 1, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """labels of one class: the network is not trained, and says what the share of that class says."""
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.createDataFrame(rows(), COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        kept = {r["a.b"]: r for r in got.collect()}
        assert set(kept) == {r[5] for r in rows()} - ({-4} if name == "near_dedup" else set()), name
        for r in rows():
            if r[5] in kept:
                k = kept[r[5]]
                assert (k["epoch"], k["turn"], k["score"], k["x y"], k["q`t"]) == (r[7], r[8], r[9], r[6], r[11]), name
                assert (k.text != r[1]) == (name == "personal_data" and "@" in (r[1] or "")), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.count() >= len(rows())


def test_stages_of_an_empty_table_are_empty(spark, folder):
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_labels_that_are_empty_reject_nothing(spark):
    docs = spark.createDataFrame(rows(), COLUMNS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == len(rows())
