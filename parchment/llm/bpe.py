"""Byte-level BPE: encoding by a sentencepiece model that is written straight from a rank file, and decoding.

The model holds one piece for each rank. A piece's bytes are mapped one to one to the characters U+0100..U+01FF,
its score is the negated rank and normalisation is identity, so sentencepiece merges the pair of the lowest rank
first, leftmost on ties, as byte-level BPE does. Texts are cut into pre-tokens first; no merge crosses one.

A null text counts as empty: no ids, no bytes. Repeated rows come out alike, an empty table gives an empty one. Ids travel as little-endian unsigned 32-bit integers in one binary
value a document. Columns of the input are kept; one that has an output's name is replaced. A text of any length
is encoded whole; only the text itself, its ids and a cache of bounded size are held.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parchment.llm.common import parts, plainly

#: Pre-tokens kept by a worker; a full cache takes no more.
CACHE_ENTRIES, CACHE_LENGTH = 100_000, 64
BASE = 0x100


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 and rank on each line) by rank; ranks run from 0 without gaps."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece, rank = line.split()
                ranks[int(rank)] = base64.b64decode(piece)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


_TO_CHARS = {i: chr(BASE + i) for i in range(256)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def to_bytes(chars: str) -> bytes:
    return chars.encode("utf-16-le")[::2]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: varint, 32-bit float, or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def build_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; one more piece, the last, is the unknown one.

    Fields: pieces 1 (piece 1, score 2, type 3: 1 normal, 2 unknown), trainer_spec 2 (model_type 3: 2 BPE,
    unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3 (name 1, add_dummy_prefix 3,
    remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    none = (1 << 64) - 1  # -1 as a varint
    out = [_field(1, _field(1, to_chars(p)) + _field(2, float(-i)) + _field(3, 1)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(40, len(pieces)) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """A worker's encoder and decoder, built from the model's bytes."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = self.sp.get_piece_size() - 1
        self.find = regex.compile(pattern).findall
        self.piece = [to_bytes(self.sp.id_to_piece(i)) for i in range(self.n)]
        self.whole = {p: i for i, p in enumerate(self.piece)}
        self.cache: dict[str, bytes] = {}

    def _ids(self, token: str) -> bytes:
        data = token.encode()
        known = self.whole.get(data)  # a pre-token that is a piece is that piece, reachable by merges or not
        ids = [known] if known is not None else self.sp.encode(to_chars(data))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        cache, out = self.cache, []
        for token in self.find(text or ""):
            ids = cache.get(token)
            if ids is None:
                ids = self._ids(token)
                if len(token) <= CACHE_LENGTH and len(cache) < CACHE_ENTRIES:  # frequent ones come early
                    cache[token] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _with_column(df: DataFrame, run, source: str, adds: dict[str, T.DataType]) -> DataFrame:
    """df with the binary columns that run(column) gives from its source column."""

    def over(batches: Iterator[pa.RecordBatch], names: list[str], read: str) -> Iterator[pa.RecordBatch]:
        act = run()
        for batch in batches:
            for at, n in parts(batch.column(batch.schema.get_field_index(read))):
                part = batch.slice(at, n)
                column = lambda name: part.column(part.schema.get_field_index(name))
                yield pa.RecordBatch.from_arrays([*map(column, names), *act(column(read))], [*names, *adds])

    return plainly(df, source, adds, over)


def model_of(spark: SparkSession, path: str):
    """The model built from a rank file on the driver, broadcast; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(build_model(read_ranks(path)))


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each whole text."""
    model = model_of(df.sparkSession, rank_file)

    def run():
        codec = Codec(model.value, pattern)
        return lambda texts: [pa.array([codec.encode(x.as_py()) for x in texts], pa.binary())]

    return _with_column(df, run, text, {ids: T.BinaryType()})


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that ids stand for; null ids count as none."""
    model = model_of(df.sparkSession, rank_file)

    def run():
        codec = Codec(model.value, pattern)
        return lambda ids: [pa.array([codec.decode(x.as_py() or b"") for x in ids], pa.binary())]

    return _with_column(df, run, ids, {decoded: T.BinaryType()})


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass over the rows."""
    model = model_of(df.sparkSession, rank_file)

    def run():
        codec = Codec(model.value, pattern)

        def act(texts: pa.Array) -> list[pa.Array]:
            found = [codec.encode(x.as_py()) for x in texts]
            return [pa.array(found, pa.binary()), pa.array([codec.decode(x) for x in found], pa.binary())]

        return act

    return _with_column(df, run, text, {ids: T.BinaryType(), decoded: T.BinaryType()})
