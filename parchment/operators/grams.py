"""Which texts can hold which needles, without a look at every pair.

Texts and needles are folded to one form of their letters, without white space. A needle's key is a hash of its whole form and
of its project. A text is hashed at every place by sums that roll: for each class of lengths the hash of a class's first
characters is looked up in a map of those that needles begin with; where it is found, the hashes of the whole lengths of that class are
looked up in a map of keys. Both maps are of bounded size and go to all tasks. What leaves a text are the keys that it holds, each
once: no text leaves its row, and rows are as many as needles are held (and a few that a map lets pass).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.functions.text import trim
from parchment.sources.scratch import MAP_BITS, small_batches, stored

#: Least lengths of the classes; a needle's class is the last one that is not above its length.
CLASSES = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 128, 256, 512]
#: Characters that are hashed together, and places and lengths of a class.
SLICE, CELLS = 1 << 15, 1 << 16
#: Bits of the largest map of first characters; it is a byte for each where it is read.
HEAD_BITS = 25
BASE, ODD = 0x9E3779B97F4A7C15, [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def folded(c: Column) -> Column:
    """One form for all letters that count as equal when case doesn't, without white space. Equal under either comparison of case gives
    equal forms; the reverse need not hold."""
    flat = F.translate(F.regexp_replace(c, r"\p{javaWhitespace}+", ""), "\u1e9e\u0130\u0307", "\u00dfI")
    # (lower() right around upper() would be taken for lower() alone)
    return F.translate(F.lower(F.translate(F.upper(flat), "\u0307", "")), "\u03c2\u0307", "\u03c3")


class _Powers:
    """Powers of BASE and of its inverse, modulo 2^64; as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            for name, by in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                factors = np.full(size, by, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def _sums(text: np.ndarray) -> np.ndarray:
    codes = text.astype(np.uint64) * ODD[0]
    codes ^= codes >> np.uint64(29)
    codes *= ODD[1]
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(codes * _Powers.of(len(text) + 1)[0][:-1], out=out[1:])
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _head(c: int) -> np.uint64:
    return np.uint64(c * int(ODD[2]) & (1 << 64) - 1)


def _keys(hashed: np.ndarray, lengths: np.ndarray, scopes: np.ndarray) -> np.ndarray:
    x = hashed + lengths.astype(np.uint64) * ODD[1] ^ scopes.view(np.uint64)
    x ^= x >> np.uint64(32)
    x *= ODD[2]
    x ^= x >> np.uint64(29)
    return x * ODD[0]


def _class_of(n: int) -> int:
    return CLASSES[bisect_right(CLASSES, n) - 1] if n else 0


def keys_of(forms: list[str], scopes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, keys and first characters' hashes of needles' forms, as signed numbers."""
    sums, n = [_sums(_points(f)) for f in forms], np.array([len(f) for f in forms], np.int64)
    whole = np.array([x[-1] for x in sums], np.uint64)
    heads = np.array([x[c] for x, c in zip(sums, map(_class_of, n.tolist()))], np.uint64) + np.array([_head(_class_of(x)) for x in n.tolist()], np.uint64)
    return n, _keys(whole, n, scopes).view(np.int64), heads.view(np.int64)


def _among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a map may have; their first bits are places in it."""
    at = keys >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def keys_in(forms: list[str], scopes: np.ndarray, lengths: list[int], heads: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of needles of these lengths that texts' forms hold: numbers of texts, and keys as signed numbers, each once for a text; a
    few others that the maps let pass. heads: a byte for each place of the map."""
    of = np.array([_class_of(n) for n in lengths])
    classes = {c: np.array(lengths)[of == c] for c in sorted({*of.tolist()})}
    longest, shift = max(lengths, default=0), np.uint64(65 - len(heads).bit_length())
    text, ends = _points("".join(forms)), np.cumsum([len(f) for f in forms])
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if 0 in classes:  # nothing but white space, which every text holds
        docs.append(np.arange(len(forms)))
        found.append(_keys(np.zeros(len(forms), np.uint64), np.zeros(len(forms)), scopes))
    size = max(SLICE, 4 * longest)
    for start in range(0, len(text), size):
        sums = _sums(text[start : start + size + longest])
        m, down = len(sums) - 1, _Powers.of(len(sums))[1]
        for c, some in classes.items():
            if not 0 < c <= m:
                continue
            x = sums[c:] - sums[:-c]
            x *= down[: m - c + 1]
            x += _head(c)
            x >>= shift
            at = np.flatnonzero(heads[x])
            step = max(1, CELLS // len(some))
            for k in range(0, len(at), step):
                doc = np.searchsorted(ends, at[k : k + step] + start, "right")
                p, d, n = np.broadcast_arrays(at[k : k + step, None], doc[:, None], some)
                fits = p + n <= np.minimum(ends[d] - start, m)
                p, d, n = p[fits], d[fits], n[fits]
                own = _keys((sums[p + n] - sums[p]) * down[p], n, scopes[d])
                ok = _among(whole, own)
                docs.append(d[ok])
                found.append(own[ok])
    both = np.unique(np.stack([np.concatenate(docs).astype(np.uint64), np.concatenate(found)]), axis=1) if len(docs) > 1 else np.zeros((2, 0), np.uint64)
    return both[0].astype(np.int64), both[1].view(np.int64)


def _map(keys: DataFrame, each: int, most: int) -> np.ndarray:
    """The bits of a column of keys, so many for each and 2 to the power `most` at most."""
    bits = min(max(15, (keys.count() * each).bit_length()), most)
    place = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits)
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in keys.groupBy(F.shiftright(place, 15).alias("piece")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("map")).toLocalIterator():
        out[r["piece"]] = np.frombuffer(r["map"], np.uint8)
    return out.reshape(-1)


def _with(df: DataFrame, columns: list[str], form: Column, on: list[str], adds: list[str], make: Callable[[list[str], np.ndarray], tuple]) -> DataFrame:
    """These columns of df, each row as often as make(forms, hashes of on) names its number, with the longs that it gives."""
    small_batches(df.sparkSession)
    inner = df.select(*columns, form.alias("_form"), F.xxhash64(*on).alias("_scope"))
    kept = len(columns)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [f or "" for f in batch.column(kept).to_pylist()]
            rows, *new = make(forms, batch.column(kept + 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in batch.columns[:kept]], *map(pa.array, new)], [*batch.schema.names[:kept], *adds])

    return inner.mapInArrow(over, T.StructType([*inner.schema.fields[:kept], *[T.StructField(n, T.LongType()) for n in adds]]))


def keyed(needles: DataFrame, on: list[str]) -> DataFrame:
    """needles (needle, *on and others) with _n (length), _key and _head, stored."""
    made = _with(needles, needles.columns, folded(trim(F.col("needle"))), on, ["_n", "_key", "_head"], lambda forms, scopes: (np.arange(len(forms)), *keys_of(forms, scopes)))
    return stored(made, "needle-keys")


def held_keys(keys: DataFrame, docs: DataFrame, on: list[str]) -> DataFrame:
    """docs (doc_id, place, *on, text and others) without the text, a row for each key of a needle that a text may hold."""
    lengths = sorted(r[0] for r in keys.select("_n").distinct().collect())  # some hundreds: needles are fields of findings
    heads, whole = _map(keys.select("_head"), 64, HEAD_BITS), _map(keys.select("_key"), 64, MAP_BITS)
    rest = [c for c in docs.columns if c != "text"]
    wide: list[np.ndarray] = []  # a byte for each bit, made once in a worker

    def make(forms: list[str], scopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not wide:
            wide.append(np.unpackbits(heads, bitorder="little"))
        return keys_in(forms, scopes, lengths, wide[0], whole)

    return _with(docs, rest, folded(F.col("text")), on, ["_key"], make)


def candidates(needles: DataFrame, docs: DataFrame, on: list[str]) -> DataFrame:
    """needles (needle, *on and others; distinct), docs (doc_id, place, *on, text and others): pairs of a needle and a document of the
    same `on` whose text may hold it, with all other columns but the text. Every pair whose folded text holds the folded needle
    is among them."""
    keys = keyed(needles, on)
    return held_keys(keys, docs, on).join(keys.drop("_n", "_head"), [*on, "_key"]).drop("_key")
