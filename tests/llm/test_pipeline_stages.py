"""Each pipeline stage on odd tables: nulls in every column, empty and long texts, repeated rows, clashing columns, no rows."""

import pytest

import corpus_pipeline

LABELS = [(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, None, None), (None, 1, 1), (5, 1, 0), (5, 0, 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _drop long, _t string, id string, _copy int, score double"


def rows():
    out = [(i, f"text number {i} has words of its own {i * i} {'idiot' if i % 9 == 1 else 'calm'}", "en", "s", 1, i, "x", "y", 1, 0.5) for i in range(60)]
    out += [(None, None, None, None, None, None, None, None, None, None), (None, "only text", None, "s", 1, 1, "x", "y", 1, 0.5), (70, None, None, None, 0, None, None, None, None, None), (71, "", "en", None, 0, None, None, None, None, None)]
    out += [(72, "long " * 30_000, "de", "s", 9, 1, "x", "y", 1, 0.5), (73, "same text here for two rows of it", "en", "s", 1, 1, "x", "y", 1, 0.5), (74, "same text here for two rows of it", "en", "s", 1, 1, "x", "y", 1, 0.5), (75, " \n\t ", "en", "s", 1, 1, "x", "y", 1, 0.5)]
    return out


@pytest.fixture
def sf(spark, tmp_path):
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, sf, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    made = stage(spark, docs, sf)
    if name != "bpe":
        assert made.columns == docs.columns
    ids = [r["doc_id"] for r in made.select("doc_id").collect()]
    clean = {2, 3, 5, 20, 30, 72, None}
    assert clean <= set(ids)
    if name == "exact dedup":
        assert 74 in ids and 73 not in ids and 71 in ids and 70 not in ids
    if name == "simhash near-dedup":
        assert (73 in ids) != (74 in ids)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_no_rows_and_no_labels(spark, tmp_path, name, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stage(spark, docs, str(tmp_path)).count() > 0
