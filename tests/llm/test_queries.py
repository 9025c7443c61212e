"""Queries with SQL return what DuckDB returns; the pipeline's stages keep and drop what they should."""

import pytest
from checker import connect, difference

import corpus_pipeline
from custlens.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), catalog.ORACLES[name]) is None


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns[: len(before)] == before
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
