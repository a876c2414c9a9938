"""Runs of repeated words: maximal stretches with a period, found by recompression.

The texts of a batch are one sequence of word numbers with a mark around each text. Rounds make it shorter: in turn, blocks
of equal symbols become one symbol each (a rule a -> b^k, whatever k), and pairs of a left and a right symbol become one,
where a seeded hash parts the symbols of a round into left and right ones. Equal rules get equal numbers, so the rounds are a
run-length grammar of the batch that parses equal stretches alike but at their edges. Two places are compared by walking up
the rounds while what lies ahead is equal and down again where it differs: how far both go on alike is exact after a few
steps for each round, however long the stretch. Mirrored, the same rounds tell how far both go back alike.

A run of period q has 3 q consecutive words at least that equal the word q later, so one of the places 0, 3 q, 6 q ... of its
text is such a word: the grid of all periods has (n / 3) ln n places. Where word and word q later are equal, both extensions
give the stretch; a stretch found with several periods keeps the smallest. Grids are walked in pieces of bounded size.

A null text has no words. Long texts are taken whole, in a batch of their own; repeated rows come out alike; an empty table
gives an empty one. Columns of the input are kept, whatever their names; one that has an output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parchment.llm.common import parts, plainly, release

#: Least length of a run in words and in periods.
LEAST, TIMES = 6, 4
#: Grid places looked at together, and symbols of a text below which no further round is made.
PIECE, SHORT = 1 << 20, 4
SEED = 0x9E3779B97F4A7C15


@dataclass
class Round:
    """The symbols of one round; `first` and `parent` tie it to the round below: first[k] is the place there where symbol k
    begins, parent[i] the symbol here that holds place i there. The lowest round has neither."""

    symbols: np.ndarray
    first: np.ndarray | None = None
    parent: np.ndarray | None = None
    blocks: bool = False


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers, others others; both are below 2**31."""
    return np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_inverse=True)[1].astype(np.int32)


def _left(symbols: np.ndarray, turn: int) -> np.ndarray:
    mixed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(SEED)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1


def recompress(words: np.ndarray, mark: np.ndarray) -> list[Round]:
    """Rounds over numbered words. Marked places are numbers that occur once; they are never put together with a neighbour."""
    rounds, turn = [Round(words.astype(np.int32))], 0
    while True:
        ends = np.flatnonzero(mark)
        if np.diff(ends).max(initial=0) <= SHORT + 1:
            return rounds
        now, blocks = rounds[-1].symbols, turn % 2 == 0
        if blocks:
            starts = np.concatenate(([True], now[1:] != now[:-1]))
        else:
            left = _left(now, turn)
            starts = np.ones(len(now), bool)
            able = ~mark[:-1] & ~mark[1:]
            one, other = left[:-1] & ~left[1:] & able, ~left[:-1] & left[1:] & able
            starts[1:] = ~(one if one.sum() >= other.sum() else other)
        turn += 1
        if starts.all():
            continue
        first = np.flatnonzero(starts)
        sizes = np.diff(np.append(first, len(now)))
        second = sizes if blocks else np.where(sizes == 2, now[np.minimum(first + 1, len(now) - 1)] + 1, 0)
        rounds.append(Round(_numbers(now[first], second), np.append(first, len(now)).astype(np.int32), (np.cumsum(starts) - 1).astype(np.int32), blocks))
        mark = mark[first]


def mirrored(rounds: list[Round]) -> list[Round]:
    out = [Round(rounds[0].symbols[::-1])]
    for low, r in zip(rounds, rounds[1:]):
        n = len(low.symbols)
        out.append(Round(r.symbols[::-1], n - r.first[::-1], len(r.symbols) - 1 - r.parent[::-1], r.blocks))
    return out


def common(rounds: list[Round], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For how many words the places i and j go on alike. A mark lies between each two of them or behind the later one."""
    top, out = len(rounds) - 1, np.zeros(len(i), np.int64)
    fallen: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in rounds]  # what differs, by round
    who, a, b = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64)
    for h, r in enumerate(rounds):
        same = r.symbols[a] == r.symbols[b]
        fallen[h].append((who[~same], a[~same], b[~same]))
        who, a, b = who[same], a[same], b[same]
        if h == top or not len(who):
            break
        up = rounds[h + 1]
        pa_, pb = up.parent[a].astype(np.int64), up.parent[b].astype(np.int64)
        both = (up.first[pa_] == a) & (up.first[pb] == b)
        # else an equal symbol ends here: a right one, or the rest of a block
        left_a, left_b = up.first[pa_ + 1] - a, up.first[pb + 1] - b
        uneven = ~both & (left_a != left_b) & up.blocks
        if uneven.any():
            go = np.minimum(left_a, left_b)[uneven]
            fallen[h].append((who[uneven], a[uneven] + go, b[uneven] + go))
        who, a, b = who[~uneven], np.where(both, pa_, pa_ + 1)[~uneven], np.where(both, pb, pb + 1)[~uneven]
    while len(who):  # texts of a few symbols in the last round
        a, b = a + 1, b + 1
        same = rounds[h].symbols[a] == rounds[h].symbols[b]
        fallen[h].append((who[~same], a[~same], b[~same]))
        who, a, b = who[same], a[same], b[same]
    for h in range(top, -1, -1):
        if not fallen[h]:
            continue
        who, a, b = (np.concatenate(x) for x in zip(*fallen[h]))
        if h == 0:
            out[who] = a
            break
        r, low = rounds[h], rounds[h - 1].symbols
        ca, cb = r.first[a].astype(np.int64), r.first[b].astype(np.int64)
        alike = low[ca] == low[cb]
        go = np.minimum(r.first[a + 1] - ca, r.first[b + 1] - cb) if r.blocks else 1
        step = np.where(alike, go, 0)
        fallen[h - 1].append((who, ca + step, cb + step))
    return out - i


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, periods and places to look at, in pieces."""
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (TIMES - 1) * period
    count = -(-(sizes[text] - period) // step)
    piece = (np.cumsum(count) - count) // PIECE
    cuts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(text))
    for at, to in zip(cuts, cuts[1:]):
        n = count[at:to]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[at:to], n), np.repeat(period[at:to], n), nth * np.repeat(step[at:to], n)


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """start, length, period of each run of each text of word numbers, by start and period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    # a mark, the first text, a mark, the second text ... a mark
    base = np.cumsum(sizes + 1) - sizes
    total = int(sizes.sum()) + len(texts) + 1
    mark = np.ones(total, bool)
    mark[np.repeat(base, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = False
    words = np.empty(total, np.int32)
    words[~mark] = np.fromiter(chain.from_iterable(texts), np.int32, int(sizes.sum()))
    words[mark] = words[~mark].max(initial=-1) + 1 + np.arange(len(texts) + 1)
    found: list[np.ndarray] = []
    ahead = back = None
    for text, period, place in _grid(sizes):
        x = base[text] + place
        same = words[x] == words[x + period]
        text, period, x = text[same], period[same], x[same]
        if not len(x):
            continue
        if ahead is None:
            ahead = recompress(words, mark)
            back = mirrored(ahead)
        forward = common(ahead, x, x + period)
        backward = common(back, total - x, total - x - period)  # from the words before
        length = period + forward + backward
        good = length >= np.maximum(LEAST, TIMES * period)
        found.append(np.unique(np.stack([text[good], x[good] - backward[good] - base[text[good]], length[good], period[good]]), axis=1))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        t, s, n, p = np.unique(np.concatenate(found, axis=1), axis=1)  # in order, the smallest period of a stretch first
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
        order = np.lexsort((p[new], s[new], t[new]))
        for a, *run in np.stack([t[new], s[new], n[new], p[new]], axis=1)[order].tolist():
            out[a].append(tuple(run))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats most often, by exact length / period; ties to the smallest start, then period."""
    best = None
    for s, n, p in runs:  # by start and period
        if best is None or n * best[2] > best[1] * p:
            best = s, n, p
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int32)
    for s, n, p in runs:
        depth[s + p] += 1
        depth[s + n] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist())


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ADDS = {"n_words": T.LongType(), "runs": T.ArrayType(RUN), "best": RUN, "collapsed": T.StringType()}


def _analysed(texts: list[str | None]) -> list[pa.Array]:
    known: dict[bytes, int] = {}
    split = [(t or "").encode().split() for t in texts]  # of bytes: ASCII white space only
    numbered = [[known.setdefault(w, len(known)) for w in words] for words in split]
    runs = runs_of(numbered)
    row = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
    kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    return [
        pa.array([len(w) for w in split], pa.int64()),
        pa.array([list(map(row, r)) for r in runs], pa.list_(kind)),
        pa.array([row(strongest(r)) for r in runs], kind),
        pa.array([collapsed(w, r).decode() for w, r in zip(split, runs)], pa.string()),
    ]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, runs (start, length, period; by start, then period), the strongest run, and the text with each run cut to
    its first period."""

    def over(batches: Iterator[pa.RecordBatch], names: list[str], source: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(source))
            for at, n in parts(texts):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], *_analysed(part.column(part.schema.get_field_index(source)).to_pylist())], [*names, *ADDS])
            release()

    return plainly(docs, text, ADDS, over)

