"""Columns of the input that have names which an operator uses itself: they come back as they were, or count for nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from parchment.llm import bpe, chat, mixing, periodic, phrases, quality_model, quality_rules, sharding, simhash, substring, topk, toxicity
from parchment.llm.common import scratch
from tests.oracle import DATA

INNER = "words joined lines good hashes sorted places said repeated chunk h leaf bucket weight slice u first source whole cut point part place of left nth gone row ids decoded".split()
NAMES = [*INNER, *(f"_{n}" for n in INNER), *(f"__{n}" for n in INNER)]
OUTPUTS = "n_words n_removed removed kept_text size target taken doc_bytes shard depth shard_bytes oversize score toxic_spans kept cleaned_text base_failed".split()
TEXT = " ".join(f"w{i}" for i in range(60)) + "."


def rows(spark, extra):
    df = spark.createDataFrame([(1, TEXT, "s"), (2, TEXT + " x", "t"), (3, None, None), (3, "a b", "s")], "doc_id long, text string, src string")
    return df.withColumns({n: F.lit("own") for n in extra})


ACTS = {
    "bpe": lambda df: bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids="i_", decoded="d_"),
    "quality_rules": quality_rules.clean,
    "periodic": periodic.find,
    "phrases": phrases.fingerprints,
    "sharding": lambda df: sharding.shard(df, limit=300),
    "substring": substring.dedup,
    "mixing": lambda df: mixing.mix(df, source="src"),
    "toxicity": lambda df: toxicity.score(df, toxicity.train([])),
    "quality_model": lambda df: quality_model.score(df, quality_model.train([])),
}


@pytest.mark.parametrize("name", sorted(ACTS))
def test_columns_come_back(spark, name):
    plain = ACTS[name](rows(spark, []))
    wide = ACTS[name](rows(spark, [*NAMES, *OUTPUTS]))
    new = [c for c in plain.columns if c not in ("doc_id", "text", "src")]
    kept = [c for c in wide.columns if c not in new and c not in ("doc_id", "text", "src")]
    assert set(kept) == {c for c in [*NAMES, *OUTPUTS] if c not in new}
    for r in wide.select(*kept).collect():
        assert set(r) == {"own"}
    assert sorted(map(str, wide.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_odd_names(spark):
    """Names that have to be quoted."""
    df = spark.createDataFrame([(1, TEXT, "s", 7, 8)], "doc_id long, text string, src string, `a.b` int, `a``b` int")
    for name, act in ACTS.items():
        r = act(df).first().asDict()
        assert (r["a.b"], r["a`b"]) == (7, 8), name
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).withColumns({"a.b": F.lit(7), "a`b": F.lit(8)})
    for name, stage in P.STAGES:
        with scratch():
            assert {(r["a.b"], r["a`b"]) for r in stage(spark, docs, DATA).collect()} == {(7, 8)}, name


def test_dropped_columns(spark):
    df = rows(spark, [*NAMES, "fp", "id", "node", "root", "component_id", "fingerprint"])
    assert sorted(simhash.near_copies(df).collect()) == sorted(simhash.near_copies(rows(spark, [])).collect())
    events = spark.createDataFrame([("c", 1, "message", "m", "user", "hi"), ("c", 2, "delta", "m", None, "!")], "conv_id string, seq long, event string, message_id string, role string, text string")
    wide = events.withColumns({n: F.lit("own") for n in ("block", "n_turns", "_turns", "_opened", "_rank", "_version", "_last")})
    assert chat.render(chat.fold(wide)).collect() == chat.render(chat.fold(events)).collect()
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    wide = vectors.withColumns({n: F.lit("own") for n in ("id", "v", "asks", "length", "group", "part", "block", "floor", "reach", "class", "score", "rank")})
    asks = F.col("vec_id") == 0
    assert topk.search(wide, asks).collect() == topk.search(vectors, asks).collect()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = [n for n in [*NAMES, *OUTPUTS, "decodes", "n_tokens"] if n not in docs.columns]
    wide = docs.withColumns({n: F.lit("own") for n in names})
    for name, stage in P.STAGES:
        with scratch():
            plain, got = stage(spark, docs, DATA), stage(spark, wide, DATA)
            kept = [n for n in names if name != "byte_bpe" or n not in ("n_tokens", "ids", "decodes")]
            assert [c for c in got.columns if c in wide.columns] == wide.columns if name != "byte_bpe" else set(kept) < set(got.columns)
            assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
            assert all(set(r) == {"own"} for r in got.select(*kept).collect())
