"""Encoding against tiktoken, decoding as a round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from parchment.llm import bpe, queries
from tests.oracle import DATA

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.build_model(bpe.read_ranks(RANKS)), P.PATTERN)


def check(codec, tik, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "\n\n  x\t", "a" * 5000, "é😀" * 50, "日本語", "▁ ▁a <unk> </s>", "\x00\x01", "ab" * 20_000, "don't I'LL 12345 ...!!"])
def test_cases(codec, tik, text):
    check(codec, tik, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, tik, text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        check(codec, tik, text)


def test_cache_starts_anew(codec, tik, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    rng = random.Random(3)
    for _ in range(20):
        check(codec, tik, " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(30)))


def test_columns_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "x")], "doc_id long, text string, ids string")
    got = bpe.encode(df, RANKS, P.PATTERN)
    assert got.columns == ["doc_id", "text", "ids"] and got.schema["ids"].dataType.typeName() == "binary"
    rows = bpe.decode(got, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == [b"", b"a b", b"a b"]
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_query(spark, tik):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = tik.encode_ordinary(d.text), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
