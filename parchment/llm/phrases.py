"""Fingerprints of texts by locally consistent parsing.

A text's code points are parsed into phrases, phrases into phrases of phrases, and so on up to one name for the whole text.
On each level runs of equal symbols become one symbol, then deterministic coin tossing gives each symbol a label of its own and
its left neighbour's value alone: twice the place of the lowest bit in which they differ, plus that bit. Neighbours' labels
differ, and four rounds leave labels below 6. A phrase begins where a label is larger than both neighbours' labels. So where a
phrase begins depends on a few symbols around it, and a stretch that two texts share is parsed alike in both but at its edges,
wherever it stands. A phrase's name is a hash of its symbols in their order, the same in all texts and on all machines.

A text's signatures are the names of its phrases from the second level on (some eight characters and more); a text with fewer than FEW
of these has its first-level phrases (some three characters) too. Its fingerprint is the name of the whole text and the least
KEPT hashes of its signatures: bounded, and exact for texts with fewer. The likeness of two fingerprints is the share of their
signatures that are common, 2 |A and B| / (|A| + |B|), estimated from the least hashes of both together.

Null counts as an empty text; the empty text has a fingerprint without signatures, like itself (1) and no other (0). Texts are
read whole, repeated rows come out alike, an empty table gives an empty one. Columns of the input are kept by fingerprints().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import parts, parts_for, plainly, release, small_batches

KEPT, FEW, ROUNDS = 64, 16, 4
#: Code points parsed together, and texts.
TOGETHER, TEXTS = 1 << 17, 1024
_U = np.uint64
_STEP, _ONE, _TWO, _RUN = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
#: A de Bruijn sequence: its product with one bit has six leading bits that tell which bit it is.
_BRUIJN = 0x03F79D71B4CA8B09
_PLACE = np.zeros(64, np.uint8)
_PLACE[[(_BRUIJN << i) % (1 << 64) >> 58 for i in range(64)]] = np.arange(64)
_BITS = 7


def _tosses() -> np.ndarray:
    """The label of (left neighbour's label, own label) for labels of seven bits."""
    left, own = np.divmod(np.arange(1 << 2 * _BITS), 1 << _BITS)
    differ = left ^ own
    place = np.zeros_like(own)
    for bit in range(_BITS - 1, -1, -1):
        place[differ >> bit & 1 == 1] = bit
    return (2 * place + (own >> place & 1)).astype(np.uint8)


_TOSS = _tosses()


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 that differ between neighbours; `first` are the places where texts begin: their left neighbour is a symbol
    that differs in the lowest bit."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ _U(1)
    differ = symbols ^ before
    low = differ & (~differ + _U(1))
    found = _PLACE[low * _U(_BRUIJN) >> _U(58)] * np.uint8(2) + ((symbols & low) != 0)
    left = np.empty(len(found), np.uint16)
    for _ in range(ROUNDS - 1):
        left[1:] = found[:-1]
        left[first] = found[first] ^ np.uint8(1)
        found = _TOSS[left << _BITS | found]
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _ONE
    return x ^ x >> _U(29)


def _once(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols as one symbol each."""
    same = symbols[1:] == symbols[:-1]
    if not same.any():
        return symbols, text
    at = np.flatnonzero(np.append(True, ~same | (text[1:] != text[:-1])))
    long = np.diff(np.append(at, len(symbols)))
    kept = symbols[at]
    more = long > 1
    kept[more] = _mixed(kept[more] + _RUN * long[more].astype(np.uint64))
    return kept, text[at]


def parse(symbols: np.ndarray, text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level's phrases, and their texts."""
    symbols, text = _once(symbols, text)
    n = len(symbols)
    edge = np.ones(n + 1, bool)
    edge[1:n] = text[1:] != text[:-1]
    label = labels(symbols, np.flatnonzero(edge[:-1]))
    begins = edge[:-1].copy()
    rises = label[1:] > label[:-1]
    begins[1:-1] |= rises[:-1] & ~rises[1:] & ~edge[2:n]
    at = np.flatnonzero(begins)
    nth = np.arange(n) - np.repeat(at, np.diff(np.append(at, n))) + 1
    named = np.add.reduceat(_mixed(symbols + _STEP * (nth + (level << 20)).astype(np.uint64)), at) * _TWO
    return named ^ named >> _U(32), text[at]


def signatures(texts: list[str], kept: int = KEPT) -> tuple[np.ndarray, list[np.ndarray]]:
    """The name of each whole text, and the least hashes of its signatures, rising."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    names, found, level = np.zeros(len(texts), np.uint64), [], 0
    low: tuple[np.ndarray, np.ndarray] | None = None
    while len(symbols):
        level += 1
        symbols, text = parse(symbols, text, level)
        count = np.bincount(text, minlength=len(texts))
        if level == 1:
            low = symbols, text
        else:
            found.append((symbols, text))
        if level == 2:  # texts that are done on the first level have none
            few = count[low[1]] < FEW
            found.append((low[0][few], low[1][few]))
        done = count[text] == 1
        names[text[done]] = symbols[done]
        symbols, text = symbols[~done], text[~done]
    if level == 1:
        found.append(low)
    if not found:
        return names, [np.zeros(0, np.uint32)] * len(texts)
    hashes = _mixed(np.concatenate([s for s, _ in found])) >> _U(32)
    distinct = np.sort(np.concatenate([t for _, t in found]).astype(np.uint64) << _U(32) | hashes)
    distinct = distinct[np.append(True, distinct[1:] != distinct[:-1])]
    owner = (distinct >> _U(32)).astype(np.int64)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    values = distinct.astype(np.uint32)  # the lower half
    return names, [values[a : min(b, a + kept)] for a, b in zip(starts.tolist(), starts[1:].tolist())]


def written(name: int, least: np.ndarray) -> str:
    return f"{int(name):016x}{least.astype('>u4').tobytes().hex()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:16], 16), np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u4").astype(np.uint32)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], kept: int = KEPT) -> float:
    if a[0] == b[0] and len(a[1]) == len(b[1]) and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1], b[1]
    both = np.intersect1d(x, y, assume_unique=True)
    union = len(x) + len(y) - len(both)
    if max(len(x), len(y)) >= kept and union > kept:  # beyond the least ones of both together, one of them may have left some out
        both = both[both <= np.partition(np.union1d(x, y), kept - 1)[kept - 1]]
        union = kept
    return 2 * len(both) / (union + len(both)) if union else 0.0


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint", kept: int = KEPT) -> DataFrame:
    """Adds the fingerprint of each whole text."""

    def over(batches: Iterator[pa.RecordBatch], names: list[str], source: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            for start, n in parts(batch.column(at), TEXTS, TOGETHER):
                part = batch.slice(start, n)
                found = signatures([x or "" for x in part.column(at).to_pylist()], kept)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], pa.array(list(map(written, *found)), pa.string())], [*names, fingerprint])

    return plainly(docs, text, {fingerprint: T.StringType()}, over)


@F.pandas_udf(T.DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of two columns of fingerprints; null if one is null."""
    return pd.Series([None if x is None or y is None else likeness(read(x), read(y)) for x, y in zip(a, b)], dtype="float64")


# ---- a text beside the next one


def _slices(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, hash, text) with `slice`, 0 for the highest ids: quantiles of ids, and of hashes within an id that spans several."""
    marks = rows.agg(F.percentile_approx(F.coalesce("id", F.lit(-(1 << 63))), [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("at")).first()["at"] if n > 1 else None
    edges = np.array(sorted(marks or []), np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        left, right = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
        share = (hashes.to_numpy(np.float64) / 2.0**64 + 0.5) * (right - left)
        return pd.Series(len(edges) - left - np.minimum(share.astype(np.int64), np.maximum(right - left - 1, 0)))

    return rows.withColumn("slice", place(F.coalesce("id", F.lit(-(1 << 63))), "hash"))


def beside_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """slice, guard, id, text in order within partitions: each row's next one by falling id (ties: falling hash of the text; null
    ids last) follows it, and the first row follows the last. A slice ends with a guard, a copy of the first row of the next
    slice. Texts are shuffled once; what the driver holds are a row for each slice."""
    small_batches(spark)
    n = parts_for(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _slices(rows, n)
    place = F.struct(F.col("id").isNotNull(), "id", "hash")
    heads = sorted((r["slice"], r["p"]["id"], r["p"]["hash"]) for r in rows.groupBy("slice").agg(F.max(place).alias("p")).collect())
    behind = [(heads[i - 1][0], id_, hash_) for i, (_, id_, hash_) in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(behind, "to int, of long, h long"))
    guards = rows.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("h"))).groupBy("to").agg(F.first("id").alias("id"), F.first("hash").alias("hash"), F.first("text").alias("text"))
    every = rows.select("slice", F.lit(0).alias("guard"), "id", "hash", "text").unionByName(guards.select(F.col("to").alias("slice"), F.lit(1).alias("guard"), "id", "hash", "text"))
    return every.repartitionById(n, F.col("slice")).sortWithinPartitions("slice", "guard", F.desc_nulls_last("id"), F.desc("hash")).select("guard", "id", "text")


def edited(text: str, other: str) -> str:
    """The last third of a text replaced by as many first characters of another one, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def compare_next(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """doc_id, n_chars, edited (the text with its last third replaced by the beginning of the next text), fingerprint, edited_fingerprint,
    near_edited, near_next (likeness to the edited text and to the next one). Other columns are dropped."""
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def done(rows: list[tuple[int, int | None, str]]) -> pa.RecordBatch:
        """The last row is looked at, not given."""
        own = [(i, t, rows[k + 1][2]) for k, (guard, i, t) in enumerate(rows[:-1]) if not guard]
        places = [k for k, (guard, _, _) in enumerate(rows[:-1]) if not guard]
        changed = [edited(t, o) for _, t, o in own]
        whole = list(zip(*signatures([t for _, _, t in rows], kept)))
        other = list(zip(*signatures(changed, kept)))
        columns = (
            [i for i, _, _ in own],
            [len(t) for _, t, _ in own],
            changed,
            [written(*whole[k]) for k in places],
            [written(*x) for x in other],
            [likeness(whole[k], x, kept) for k, x in zip(places, other)],
            [likeness(whole[k], whole[k + 1], kept) for k in places],
        )
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int | None, str]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                size += len(row[2])
                if size >= TOGETHER or len(rows) >= TEXTS:
                    if len(rows) > 1:
                        yield done(rows)
                    rows = rows[-1:]
                    size = len(rows[0][2])
            release()
        if len(rows) > 1:
            yield done(rows)

    ordered = beside_next(docs.sparkSession, docs)
    return ordered.mapInArrow(over, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
