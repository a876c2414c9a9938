"""Toxic spans by a linear-chain conditional random field over words; marginals give document scores and offsets.

Words are labelled toxic or not. A word's own score for "toxic" adds the weights of its hashed features (the word in lower
case without marks around it, its beginnings and endings); a 2 x 2 table scores neighbours. Forward-backward gives each
word's marginal. A text is one chain, whatever its length.

Labels are known for documents only, so words are labelled first: in a toxic training document, words and beginnings that
toxic documents have, or have twice, far more often than others are toxic; all other words are not. Near copies in the
sample count once. Three quarters of the sample fit the field by gradient steps on its likelihood, the rest fits the
logistic step from marginals to the document's score. A label with fewer than four different texts has all of them in
both parts.

A null or empty text has no words and gets the score of a text without suspicious words. Labels of other values than 0
and 1 are ignored; without labels of both kinds, or without a word that tells them apart, no model is fitted: every text
scores the share of label 1 among different texts (0 if there is no label), which says nothing of a text. Repeated
rows score alike, an empty table gives an empty one. Extra columns are kept, those with an output's name replaced. Texts
are scored whole: a long one is passed in segments, and messages are carried from segment to segment.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parchment.llm.common import WORD, parts, plainly
from parchment.llm.labelled import fitted, sample, shift

#: Words of a segment: segments of all texts are passed side by side.
SPAN, DIMS = 64, 1 << 18
#: Words whose messages are held together, or one text.
TOGETHER = 1 << 20
#: Bounds of the sample that the field is fitted on.
PER_CLASS, MAX_CHARS = 2000, 20_000
CACHE_WORDS = 100_000
SPLIT = re.compile(WORD)
EDGE = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "¡¿«»“”‘’„…–—"


def features(word: str) -> list[str]:
    """The word, its beginnings, and, last, its endings."""
    w = word.lower().strip(EDGE)
    n, names = len(w), ["w" + w]
    for k in (3, 4, 5, 6):
        if n > k:
            names.append("b" + w[:k])
    for k in (3, 4):
        if n > k:
            names.append("e" + w[-k:])
    return names


def hashed(names: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(n) for n in names]


def split(text: str | None) -> list[str]:
    return SPLIT.findall(text or "")


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each word of texts of these sizes stands in a (SPAN, n) array that is read column by column; each text's first
    column, and n. A text fills its columns one after another."""
    columns = -(-sizes // SPAN)
    first = np.cumsum(columns) - columns
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(columns.sum())
    return place % SPAN * n + np.repeat(first, sizes) + place // SPAN, first, n


def _even(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of odds stay what they are when both rows are divided by the same number."""
    total = (x + y).sum(0)
    return x / total, y / total


def marginals(scores: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """scores of label 1 against 0, one for each word of texts of these sizes; table [from, to]. Odds of label 1, and the
    messages ahead and back and the words' own factors, from which pairs() takes what it needs.

    Messages are kept as odds, so that texts of any scores and lengths neither overflow nor vanish. From one segment to
    the next they go through the segment's map (a x + b) / (c x + d), the product of its words' maps.
    """
    e, m = np.exp(np.clip(scores, -30, 30)), np.exp(table)
    at, first, n = places(sizes)
    if not n:
        return e, e, e, e
    columns = -(-sizes // SPAN)
    grid, real = np.ones(SPAN * n), np.zeros(SPAN * n + n, bool)
    grid[at], real[at] = e, True
    grid, real = grid.reshape(SPAN, n), real.reshape(SPAN + 1, n)
    some = columns > 0
    start, last = np.zeros(n, bool), np.zeros(n, bool)
    start[first[some]], last[(first + columns - 1)[some]] = True, True
    most = int(columns.max())
    # messages ahead: what each column gets from the one before
    got = np.zeros(n)
    full = np.flatnonzero(~last)
    if len(full):
        own = grid[:, full]
        x, y = np.array([own[0] * m[1, 1], own[0] * m[0, 1]]), np.array([np.full(len(full), m[1, 0]), np.full(len(full), m[0, 0])])
        opens = start[full]
        x[:, opens], y[:, opens] = [np.zeros(opens.sum()), own[0, opens]], [[0.0], [1.0]]
        for t in range(1, SPAN):
            x, y = own[t] * (m[1, 1] * x + m[0, 1] * y), m[1, 0] * x + m[0, 0] * y
            if t % 8 == 7:
                x, y = _even(x, y)
        of = np.cumsum(~last) - 1  # a column's place in full
        for k in range(1, most):
            c = (first + k)[columns > k]
            f, before = of[c - 1], got[c - 1]
            got[c] = (x[0, f] * before + x[1, f]) / (y[0, f] * before + y[1, f])
    ahead = np.empty_like(grid)
    ahead[0] = np.where(start, grid[0], grid[0] * (m[0, 1] + m[1, 1] * got) / (m[0, 0] + m[1, 0] * got))
    for t in range(1, SPAN):
        ahead[t] = grid[t] * (m[0, 1] + m[1, 1] * ahead[t - 1]) / (m[0, 0] + m[1, 0] * ahead[t - 1])
    # messages back: what each column's end gets from the one behind; 1 at a text's end
    behind = np.ones(n)
    step = lambda x: (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
    if len(full):
        b = np.ones(int(last.sum()))
        own, known = grid[:, last], real[:, last]
        for t in range(SPAN - 1, 0, -1):
            b = np.where(known[t], step(own[t] * b), 1.0)
        entry = np.ones(n)
        entry[last] = step(own[0] * b)  # what the column before a last one gets
        inner = np.flatnonzero(~last & ~start)
        own = grid[:, inner]
        x, y = np.array([np.ones(len(inner)), np.zeros(len(inner))]), np.array([np.zeros(len(inner)), np.ones(len(inner))])
        for t in range(SPAN - 1, -1, -1):
            z = own[t] * x
            x, y = m[1, 1] * z + m[1, 0] * y, m[0, 1] * z + m[0, 0] * y
            if t % 8 == 0:
                x, y = _even(x, y)
        of = np.cumsum(~last & ~start) - 1
        for k in range(most - 2, -1, -1):
            c = (first + k)[columns > k + 1]
            behind[c] = entry[c + 1]
            c = c[~start[c]]
            f = of[c]
            entry[c] = (x[0, f] * behind[c] + x[1, f]) / (y[0, f] * behind[c] + y[1, f])
    back = np.empty_like(grid)
    back[-1] = behind
    for t in range(SPAN - 2, -1, -1):
        back[t] = np.where(real[t + 1], step(grid[t + 1] * back[t + 1]), 1.0)
    ahead, back = ahead.ravel()[at], back.ravel()[at]
    return ahead * back, ahead, back, e


def pairs(ahead: np.ndarray, back: np.ndarray, e: np.ndarray, table: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Expected numbers of neighbours (from, to); joined: which words are followed by one of the same text."""
    m = np.exp(table)
    x, y = ahead[:-1][joined], (e * back)[1:][joined]
    each = 1 / (m[0, 0] + m[0, 1] * y + m[1, 0] * x + m[1, 1] * x * y)
    return m * np.array([[each.sum(), (each * y).sum()], [(each * x).sum(), (each * x * y).sum()]])


def followed(sizes: np.ndarray) -> np.ndarray:
    """Which words, but the last, have the next one in the same text."""
    out = np.ones(max(0, int(sizes.sum())), bool)
    out[np.cumsum(sizes)[sizes > 0] - 1] = False
    return out[:-1]


def slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of TOGETHER words at most, or of one text."""
    cuts, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > TOGETHER:
            cuts.append(i)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], len(sizes)]))


@dataclass
class Model:
    weights: np.ndarray
    table: np.ndarray
    document: np.ndarray  # of 1, the largest log odds, log(1 + expected toxic words)
    constant: float | None = None

    @property
    def fitted(self) -> bool:
        return self.constant is None


def _apart(texts: list[list[str]]) -> list[int]:
    """Texts without near copies of earlier ones: two least hashes of five-word shingles tell them."""
    import xxhash

    seen, kept = set(), []
    for i, words in enumerate(texts):
        shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        marks = {(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in (1, 2)}
        if seen.isdisjoint(marks):
            kept.append(i)
        seen |= marks
    return kept


@dataclass
class _Vocabulary:
    """Distinct words by number, and the hashes of their features one word after another."""

    words: dict[str, int]
    feature: np.ndarray
    of_word: np.ndarray
    ending: np.ndarray

    @classmethod
    def of(cls, texts: list[list[str]]) -> _Vocabulary:
        words = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        flat, size, ending = array("Q"), array("l"), bytearray()
        for w in words:
            names = features(w)
            flat.extend(hashed(names))
            size.append(len(names))
            ending.extend(n[0] == "e" for n in names)
        return cls(words, np.array(flat, np.uint64), np.repeat(np.arange(len(words)), size), np.frombuffer(bytes(ending), bool))


def _toxic_words(known: _Vocabulary, texts: list[np.ndarray], labels: list[int], share: float = 0.02, rare: float = 0.015, times: float = 25.0) -> np.ndarray:
    """Which words count as toxic in a toxic text: those with a toxic feature.

    A feature is toxic if toxic documents have it, or have it twice, `times` as often as others and it is in a `share` of
    them, or if it is in a share `rare` of them that no such feature explains; in three of them at least. Endings don't
    count.
    """
    whole = ~known.ending
    names, feature = np.unique(known.feature[whole], return_inverse=True)
    of_word = known.of_word[whole]
    first, last = np.searchsorted(of_word, np.arange(len(known.words))), np.searchsorted(of_word, np.arange(len(known.words)), "right")

    def own(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of different words of a text, and how many words have them."""
        w = np.unique(words)
        n = last[w] - first[w]
        return np.unique(feature[np.repeat(first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], return_counts=True)

    n, seen = Counter(labels), np.zeros((2, 2, len(names)), np.int64)  # once or more, twice or more
    least = max(3, math.ceil(rare * n[1]))
    for words, y in zip(texts, labels):
        f, k = own(words)
        seen[0, y, f] += 1
        seen[1, y, f[k > 1]] += 1
    often = [(s[1] >= least) & (s[1] / n[1] >= times * (s[0] + 0.5) / n[0]) for s in seen]
    telling = often[0] | often[1]
    toxic = telling & (np.where(often[0], seen[0, 1], seen[1, 1]) >= max(least, share * n[1]))
    left = [f[telling[f]] for words, y in zip(texts, labels) if y and not toxic[f := own(words)[0]].any()]
    while left:
        found, k = np.unique(np.concatenate(left), return_counts=True)
        if not len(k) or k.max() < least:
            break
        best = found[k.argmax()]
        toxic[best] = True
        left = [f for f in left if best not in f]
    out = np.zeros(len(known.words), bool)
    out[of_word[toxic[feature]]] = True
    return out


def _document_inputs(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: 1, its largest log odds, log(1 + expected toxic words)."""
    out = np.zeros((len(sizes), 3))
    out[:, 0], out[:, 1] = 1, -12
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        out[some, 1] = np.clip(np.log(np.maximum.reduceat(p, first)), -12, 12)
        likely = np.where(p > 0.25, p / (1 + p), 0)
        out[some, 2] = np.log1p(np.add.reduceat(likely, first))
    return out


def train(rows: list[tuple[str, int]], steps: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Fits a model on (text, label); the same rows give the same model."""
    labels = [y for _, y in rows]
    same: dict[str, str] = {}
    texts = [[same.setdefault(w, w) for w in split(t)] for t, _ in rows]  # a word is kept once
    apart = _apart(texts)
    texts, labels = [texts[i] for i in apart], [labels[i] for i in apart]
    none = Model(np.zeros(DIMS, np.float32), np.zeros((2, 2)), np.zeros(3), sum(labels) / max(1, len(labels)))
    nth = [labels[:i].count(y) for i, y in enumerate(labels)]  # of its label
    all_labels, few = labels, [labels.count(y) < 4 for y in (0, 1)]
    part = lambda x, own: [v for i, y, v in zip(nth, all_labels, x) if few[y] or (i % 4 < 3) == own]
    others, their_labels, texts, labels = part(texts, False), part(labels, False), part(texts, True), part(labels, True)
    if len({*labels}) < 2 or len({*their_labels}) < 2:
        return none
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return none
    known = _Vocabulary.of(texts)
    word = np.fromiter((known.words[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    toxic = _toxic_words(known, np.split(word, ends[:-1]), labels)
    if not toxic.any():
        return none
    y = toxic[word] & np.repeat(np.array(labels, bool), sizes)
    of_word, feature, count = known.of_word, (known.feature % np.uint64(DIMS)).astype(np.int64), len(known.words)
    runs = [(sizes[a:z], slice(ends[a] - sizes[a], ends[z - 1])) for a, z in slices(sizes)]
    joined = followed(sizes)
    counted = np.bincount(y[:-1][joined] * 2 + y[1:][joined], minlength=4).reshape(2, 2)
    weights, table, bias = np.zeros(DIMS), np.zeros((2, 2)), -4.0
    moved, n_toxic = [np.full(DIMS, 1e-6), np.full((2, 2), 1e-6), 1e-6], max(1.0, y.sum())
    for _ in range(steps):
        own_scores = np.bincount(of_word, weights[feature], count) + bias
        by_word, expected = np.zeros(count), np.zeros((2, 2))
        for part, at in runs:
            odds, *messages = marginals(own_scores[word[at]], part, table)
            by_word += np.bincount(word[at], y[at] - odds / (1 + odds), count)
            expected += pairs(*messages, table, followed(part))
        by_word /= n_toxic
        by_feature = np.bincount(feature, by_word[of_word], DIMS) - decay * weights
        by_table = (counted - expected) / n_toxic - decay * table
        by_bias = by_word.sum()
        moved = [moved[0] + by_feature**2, moved[1] + by_table**2, moved[2] + by_bias**2]
        weights += rate * by_feature / np.sqrt(moved[0])
        table += rate * by_table / np.sqrt(moved[1])
        bias += rate * by_bias / np.sqrt(moved[2])
    model = Model(np.append(weights, bias).astype(np.float32), table, np.zeros(3))
    tagger = Tagger(model)
    sizes = np.array([len(t) for t in others])
    inputs, target = _document_inputs(tagger.odds(others, sizes), sizes), np.array(their_labels, float)
    coef = np.zeros(3)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(inputs @ coef, -30, 30)))
        grade = inputs.T @ (target - p) - 0.1 * coef
        coef += np.linalg.solve((inputs * (p * (1 - p))[:, None]).T @ inputs + 0.1 * np.eye(3), grade)
    model.document = coef
    return model


class Tagger:
    """A worker's scorer; scores of words are kept up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, _Scores(model.weights)

    def odds(self, texts: list[list[str]], sizes: np.ndarray) -> np.ndarray:
        """Odds of every word, text by text."""
        look, found = self.known.__getitem__, [np.zeros(0)]
        for a, z in slices(sizes):
            scores = np.fromiter((s for t in texts[a:z] for s in map(look, t)), np.float64, int(sizes[a:z].sum()))
            found.append(marginals(scores, sizes[a:z], self.model.table)[0])
        return np.concatenate(found)

    def documents(self, texts: list[str | None], limit: float) -> tuple[list[float], list[list[dict]]]:
        """Scores, and spans (characters from 0, end not included) of words in a row whose marginal is `limit` or more."""
        words = [split(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        if self.model.constant is not None:
            return [self.model.constant] * len(texts), [[] for _ in texts]
        p = self.odds(words, sizes)
        scores = 1 / (1 + np.exp(-np.clip(_document_inputs(p, sizes) @ self.model.document, -30, 30)))
        bad, spans = p >= limit / (1 - limit), []
        for text, x, n in zip(texts, (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
            found: list[dict] = []
            if n and bad[x : x + n].any():
                last = -2
                for i, m in enumerate(SPLIT.finditer(text)):
                    if bad[x + i]:
                        if i == last + 1 and found:
                            found[-1]["end"] = m.end()
                        else:
                            found.append({"start": m.start(), "end": m.end()})
                        last = i
            spans.append(found)
        return scores.tolist(), spans


class _Scores(dict):
    """Scores of words; full, it takes no more: frequent words come early."""

    def __init__(self, weights: np.ndarray):
        import xxhash

        super().__init__()
        self.weights, self.bias, self.hash = weights[:-1].tolist(), float(weights[-1]), xxhash.xxh64_intdigest

    def __missing__(self, word: str) -> float:
        weights, hash_ = self.weights, self.hash
        value = self.bias
        for name in features(word):
            value += weights[hash_(name) % DIMS]
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """The model of a bounded sample of labelled documents; its log odds stand for the share of toxic ones among all."""
    model, had = fitted(sample(docs, labels, "toxic", modulus, remainder, per_class, max_chars), train)
    model.document = model.document + [shift(labels, "toxic", modulus, remainder, had), 0, 0]
    return model


def score(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """Adds score (0 to 1) and toxic_spans (start, end in characters)."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    adds = {"score": T.DoubleType(), "toxic_spans": span}

    def over(batches: Iterator[pa.RecordBatch], names: list[str], read: str) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for batch in batches:
            for at, n in parts(batch.column(batch.schema.get_field_index(read))):
                part = batch.slice(at, n)
                column = lambda name: part.column(part.schema.get_field_index(name))
                scores, spans = tagger.documents(column(read).to_pylist(), limit)
                yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(scores, pa.float64()), pa.array(spans, kind)], [*names, *adds])

    return plainly(docs, text, adds, over)
