"""The stages one after the other, on the small tables and on hard rows."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from barelake.llm import quality, similar

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs.cache())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs)
    return out


def test_stages(spark, stages):
    raw, good, single, clean, mixed, packed = stages
    assert all(s.columns == raw.columns for s in (good, single, clean, mixed))
    judged = {r["doc_id"]: r["keep"] for r in quality.classify(raw, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, keep in judged.items() if keep}
    roots = {r["component_id"] for r in similar.near_components(good).collect()}
    assert {r["doc_id"] for r in single.collect()} == roots
    assert clean.count() == single.count()
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9]", r["text"]) for r in clean.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_hard_rows(spark, hard, tmp_path):
    hard.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5
