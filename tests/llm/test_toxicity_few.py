"""Toxic labels on a few different texts only: clean documents stay."""

import pytest

import corpus_pipeline as P
from parchment.llm.queries import op8_toxicity
from tests.llm.test_toxicity import BAD, made


@pytest.fixture
def copies(spark, tmp_path):
    def make(different: int) -> tuple:
        clean = [t for t, y in made(400, 5) if not y]
        toxic = [f"{t} {' '.join(BAD)}" for t in [t for t, y in made(40, 6) if not y][:different]]
        rows = [*enumerate(clean), *((1000 + i, toxic[i % different]) for i in range(200))]
        docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path), docs

    return make


def test_copies_of_three_texts(spark, copies):
    at, docs = copies(3)
    left = [r.doc_id for r in P.toxic_documents(spark, docs, at).collect()]
    assert sorted(left) == list(range(200))
    assert {r.doc_id for r in op8_toxicity(spark, at).where("predicted = 1").collect()} == set(range(1000, 1200))


def test_no_model(spark, copies):
    at, docs = copies(1)
    assert P.toxic_documents(spark, docs, at).count() == 400
    assert op8_toxicity(spark, at).where("predicted = 1").count() == 0
