"""The pipeline's stages against brute-force versions of what each decides."""

import shutil
from pathlib import Path

import pytest

import corpus_pipeline as P
from parchment.llm import toxicity
from parchment.llm.common import shared_dir
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_substring import brute
from tests.oracle import DATA

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").limit(150).cache()


def test_names_and_columns(spark, docs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    assert P.ORACLE_SQL is None
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == COLUMNS
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_near_copies(spark, docs):
    """Five words and a similarity of 0.8 or more, of which the stage's rows of least id stay, once each."""
    root = groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in P.near_copies(spark, docs.union(docs), DATA).collect()) == sorted({*root.values()})


def test_rows_of_one_id(spark):
    rows = [(7, "one two three", "en", "a", 1), (7, "quite another text", "de", "b", 2), (7, "one two three", "en", "a", 1), (None, "x", "en", "a", 1), (None, "x", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [P.near_copies(spark, df.repartition(n), DATA).collect() for n in (1, 3, 5)]
    assert all(sorted(map(str, g)) == sorted(map(str, got[0])) for g in got)
    assert [r.doc_id for r in got[0]].count(7) == 1 and len(got[0]) == 3


def test_toxic_documents(spark, docs):
    """What goes is what a model of all labelled documents scores 0.3 or more; clean labels stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = dict(zip([r.doc_id for r in docs.collect()], toxicity.Tagger(model).documents([r.text for r in docs.collect()], 0.5)[0])) if model.fitted else {}
    want = [r for r in docs.collect() if scores.get(r.doc_id, 0) < P.TOXIC]
    assert sorted(P.toxic_documents(spark, docs, DATA).collect()) == sorted(want)


def test_passages(spark, docs):
    rows = docs.collect()
    want = {r.doc_id: (kept if n else r.text) for r, (kept, n) in zip(rows, brute([(r.doc_id, r.text) for r in rows])) if kept or not n}
    got = P.repeated_passages(spark, docs, DATA).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_mixing(spark, docs):
    got = P.mixed_sources(spark, docs, DATA).collect()
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(got) - 1.5 * size(docs.collect())) <= 20


def test_encoding(spark, docs):
    got = P.encoded(spark, docs, DATA).collect()
    assert len(got) == docs.count() and all(r.decodes and len(r.ids) == 4 * r.n_tokens for r in got)


def test_run(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{DATA}/labels.parquet", tmp_path / "labels.parquet")
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = {*shared.iterdir()} if shared.exists() else set()
    got = P.run(spark, str(tmp_path))
    assert got.count() > 0 and got.where("NOT decodes").count() == 0
    left = {*shared.iterdir()} - before
    assert [p.name.rsplit("-", 1)[0] for p in left] == ["mixing"]  # what the result is read from


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", None, "a", 3), (3, "w " * 300, "en", None, 600), (3, "w " * 300, "en", None, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        df = stage(spark, df, DATA)
    assert {1, None} <= {r.doc_id for r in df.collect()} and df.where("NOT decodes").count() == 0
