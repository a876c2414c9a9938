"""Quality by logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader, scored as dot products.

n-grams are single words, pairs of words, and runs of one to three word shapes (a shape writes each run of letters,
capitals, digits or a mark as one sign, so that words never seen before still count). Each is hashed to one of DIMS
weights; a text's value of a weight is its count by the root of all its n-grams.

A null or empty text has no n-grams and scores by the bias. Labels of other values than 0 and 1 are ignored; without labels of
both kinds every text scores the share of label 1 (0 if there is no label). Repeated rows score alike, an empty table gives
an empty one. Extra columns are kept, those with an output's name replaced. Texts are scored whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parchment.llm.common import parts, plainly
from parchment.llm.labelled import fitted, sample, shift

DIMS = 1 << 20
#: Bounds of the sample that the weights are fitted on.
PER_CLASS, MAX_CHARS = 3000, 20_000
CACHE_WORDS = 100_000
_RUNS = re.compile(r"(\d)\d*|([^\W\d_])[^\W\d_]*|(.)\3*", re.S)


def shape(word: str) -> str:
    """'Don't' is 'Aa'a', 'ABC!!' is 'AA!!', '12' is '9'."""
    out = []
    for m in _RUNS.finditer(word):
        run = m.group()
        if m.group(1):
            out.append("9")
        elif m.group(2):
            out.append("AA" if len(run) > 1 and run.isupper() else "Aa" if run[0].isupper() else "a")
        else:
            out.append(run[:2])
    return "".join(out)


class _Words(dict):
    """Two hashes of a word: of itself and of its shape; full, it takes no more."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        import xxhash

        value = (xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape(word.decode()), 1))
        if len(self) < CACHE_WORDS:  # frequent words come early
            self[word] = value
        return value


_WORDS = _Words()


def grams(text: str | None) -> np.ndarray:
    """The places of a text's n-grams among the weights, repeats included."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64)
    look = _WORDS.__getitem__
    both = np.fromiter((h for w in words for h in look(w)), np.uint64, 2 * len(words))
    w, s = both[::2], both[1::2]
    k = np.uint64(0x9E3779B97F4A7C15)
    two, three = s[:-1] * k + s[1:], s[:-2] * k * k + s[1:-1] * k + s[2:]
    parts = [w, w[:-1] * k + w[1:] + np.uint64(7), s, two + np.uint64(11), three + np.uint64(13)]
    found = np.concatenate(parts)
    found = (found ^ found >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (found >> np.uint64(44)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One sparse dot product for each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found = [grams(t) for t in texts]
        sums = np.array([self.weights[g].sum(dtype=np.float64) / max(1, len(g)) ** 0.5 for g in found])
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))


def train(rows: list[tuple[str, int]], passes: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> Model:
    """FTRL-proximal over (text, label), in an order that a seed fixes."""
    labels = [y for _, y in rows]
    if len(set(labels)) < 2:
        return Model(np.zeros(DIMS, np.float32), 0.0, sum(labels) / max(1, len(labels)))
    inputs = []
    for text, _ in rows:
        g, n = np.unique(grams(text), return_counts=True)
        inputs.append((np.append(g, DIMS), np.append(n / max(1, n.sum()) ** 0.5, 1.0)))  # the last place is the bias
    z, squares = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def leader(g: np.ndarray) -> np.ndarray:
        over = np.sign(z[g]) * np.maximum(np.abs(z[g]) - l1, 0)
        return -over / ((beta + np.sqrt(squares[g])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            g, x = inputs[i]
            w = leader(g)
            slope = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            z[g] += slope - (np.sqrt(squares[g] + slope**2) - np.sqrt(squares[g])) / alpha * w
            squares[g] += slope**2
    w = leader(np.arange(DIMS + 1))
    return Model(w[:DIMS].astype(np.float32), float(w[DIMS]))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """The model of a bounded sample of labelled documents; its log odds stand for the share of good ones among all."""
    model, had = fitted(sample(docs, labels, "quality", modulus, remainder, per_class, max_chars), train)
    model.bias += shift(labels, "quality", modulus, remainder, had)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch], names: list[str], read: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in parts(batch.column(batch.schema.get_field_index(read))):
                part = batch.slice(at, n)
                column = lambda name: part.column(part.schema.get_field_index(name))
                yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(held.value.score(column(read).to_pylist()), pa.float64())], [*names, "score"])

    return plainly(docs, text, {"score": T.DoubleType()}, over)
