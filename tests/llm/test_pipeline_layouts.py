"""The mix and the pipeline's stages: reruns and file layouts agree, empty tables, nulls and clashing columns have defined results."""

from collections import Counter

import pytest

from sparquill.llm import mixing
from tests.conftest import SF
from tests.llm.test_llm import NULLS, SCHEMA, corpus


@pytest.fixture
def layouts(spark, tmp_path):
    def of(rows, schema, names=("a", "b")):
        for k, name in enumerate(names):
            spark.createDataFrame(rows[:: -1 if k else 1], schema).repartition(2 + 3 * k).write.parquet(str(tmp_path / name))
        return [spark.read.parquet(str(tmp_path / name)) for name in names]

    return of


def test_mix_does_not_follow_the_files(layouts, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 10)
    rows = corpus(n=120) + [(None, "again and again", "s1", *NULLS)] * 47 + [(k, f"w{k % 7} " * (k % 30 + 1), "s2", *NULLS) for k in range(300, 500)]
    found = [Counter((r._row.doc_id, r._size, r._order_, r._taken) for r in mixing.mix(docs, columns=("doc_id", "text")).selectExpr("*", "hash(_row) AS _order_").collect()) for docs in layouts(rows, SCHEMA)]
    assert found[0] == found[1] and found[0].total() == len(rows)
    assert len({n for (i, *_, n) in found[0] if i is None}) > 1  # of the equal rows some are taken more often


def test_stages_of_nothing(spark, table):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = table([], docs.schema)
    for name, stage in pipeline.STAGES:
        found = stage(spark, empty, SF)
        assert found.count() == 0, name
        assert name == "tokens" or found.columns == docs.columns


def test_stages_agree_on_two_layouts(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionByName(docs.limit(20)).coalesce(1).write.parquet(str(tmp_path / "x"))
    docs = spark.read.parquet(str(tmp_path / "x"))
    docs.repartition(5, "text").write.parquet(str(tmp_path / "y"))
    for name, stage in pipeline.STAGES:
        runs = []
        for side in "xy":
            found = stage(spark, spark.read.parquet(str(tmp_path / side)), SF)
            found = found.select("doc_id", "n_tokens", "ids_crc32") if name == "tokens" else found
            runs.append(Counter(map(repr, found.collect())))
        assert runs[0] == runs[1] and runs[0], name


def test_quality_and_tokens_leave_columns_alone(spark, table):
    import corpus_pipeline as pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, hash string, at string, _quality int, _id string, kept boolean, n_tokens int, start string"
    rows = [(k if k else None, " ".join(f"t{k * j % 97}" for j in range(1, 80)) if k != 4 else None, "en", "s", 1, "i", "h", "a", 2, "x", False, 3, "s") for k in range(8)]
    docs = table(rows, kind)
    found = pipeline.quality_rules(spark, docs, SF)
    assert found.columns == docs.columns and {tuple(r) for r in found.collect()} <= set(rows)
    assert None not in {r.text for r in found.collect()}
    out = pipeline.token_file(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in out) == list(range(8)) and min(r.n_tokens for r in out) == 1
