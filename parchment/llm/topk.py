"""Exact top-k by inner product: vectors grouped by length, each group pruned by the cosine that a query still needs.

Components become floor(scale * x), so products are whole numbers. Candidates are dealt to buckets of like length (norm).
A query's floor is its k-th best product among the longest vectors of all, a seed of bounded size. A bucket whose
longest vector is l can only hold a better one for query q if its cosine is at least floor / (|q| l); above 1 the bucket
is skipped whole. For what is left, the local threshold chooses: low, candidates are cut by length alone; high, by
coordinates too, as a vector within that angle of q has its coordinate at q's largest one in a narrow range. Products of
what passes are taken exactly.

Queries stand in classes by the first group that can still serve them, so that neither they nor a group's candidates are
sent where no product is left to take; within a class they are dealt to blocks, and a block and a bucket meet in one
task. A group of one length, such as many equal vectors, is dealt to as many buckets as it needs. A bucket gives k rows
for a query at most.

Vectors that are null or hold null, NaN or an infinity take no part, nor do null ids; shorter vectors are filled with zeros.
Finite components of any size count: products are taken in floating point, in 64 bits or in whole numbers of any length,
as the lengths demand; a score beyond 64 bits is given, and ranked, as the nearest 64-bit number. Equal scores go to the
smaller id. Rows of a query's own id are no candidates for it; repeated rows are candidates each, and one query. An empty
table gives none. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import stored

SCALE, BUCKET, BLOCK, SEED_ROWS = 256, 8192, 4096, 2048
#: Groups of like length at most.
GROUPS = 256
#: Local cosine above which coordinates prune as well.
COSINE = 0.6
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    fits = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.coalesce(fits, F.lit(False))


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of numbers, filled with zeros to the longest."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


class Whole:
    """Rows of floor(scale * x) and their lengths."""

    def __init__(self, rows: np.ndarray, scale: int):
        self.raw, self.scale = rows, scale
        with np.errstate(over="ignore", invalid="ignore"):
            self.rows = np.floor(rows * scale)
            self.lengths = np.linalg.norm(self.rows, axis=1)

    def ints(self, at: np.ndarray | slice) -> list[list[int]]:
        """Whole numbers of any length; where a number has no fraction, scaling it can't round."""
        return [[int(x) * self.scale if abs(x) >= 2.0**53 else math.floor(x * self.scale) for x in row] for row in self.raw[at].tolist()]

    def dots(self, at: np.ndarray | slice, other: "Whole", q: int) -> np.ndarray:
        """Products of the rows at `at` with other's row q, within 64 bits."""
        bound = float(self.lengths[at].max(initial=0)) * float(other.lengths[q])
        if bound < 2.0**52:  # floating point holds every sum
            return (self.rows[at] @ other.rows[q]).astype(np.int64)
        if bound < 2.0**62 and np.abs(self.rows[at]).max() < 2.0**62 and np.abs(other.rows[q]).max() < 2.0**62:
            return self.rows[at].astype(np.int64) @ other.rows[q].astype(np.int64)
        asked = other.ints([q])[0]
        return np.array([min(MOST, max(LEAST, sum(map(int.__mul__, row, asked)))) for row in self.ints(at)], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -(scores[keep].astype(object))))][:k]


def search_bucket(ids: np.ndarray, rows: Whole, query_ids: np.ndarray, queries: Whole, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score): up to k of each query's candidates in this bucket that reach its floor. Rows stand by length, longest first."""
    found, eps = [], 1e-9
    if not len(ids):
        return found
    lengths, asked = rows.lengths, queries.lengths
    need = floors / np.maximum(asked * lengths[0], eps)  # the local cosine
    for q in np.flatnonzero((floors <= 0) | (need <= 1 + eps)).tolist():
        floor, length = floors[q], max(asked[q], eps)
        n = len(ids)
        if floor > 0:  # by length: no product passes |q| times the candidate's length
            n = int(np.searchsorted(-lengths, -(floor / length) * (1 - eps), "right"))
        passed: np.ndarray | slice = slice(0, n)
        if floor > 0 and need[q] > COSINE and n:
            j = int(np.argmax(np.abs(queries.rows[q])))
            x, c = queries.rows[q, j] / length, np.minimum(1.0, floor / (length * np.maximum(lengths[:n], eps)))
            # within the angle whose cosine is c, coordinate j lies between these
            spread = np.sqrt(np.maximum(0, 1 - c * c)) * math.sqrt(max(0.0, 1 - x * x)) + 1e-7
            own = rows.rows[:n, j] / np.maximum(lengths[:n], eps)
            passed = np.flatnonzero(np.abs(own - c * x) <= spread + (1 - c) * abs(x))
        near, scores = ids[passed], rows.dots(passed, queries, q)
        ok = (scores >= floor) & (near != query_ids[q])
        near, scores = near[ok], scores[ok]
        top = best(scores, near, k)
        found += [(int(query_ids[q]), int(i), int(s)) for i, s in zip(near[top], scores[top])]
    return found


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` holds for, its k best among all other ids."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.elementType
    form = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    usable_rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = usable_rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(form).alias("v"), queries.alias("asks"))
    square = lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0))
    far = F.exists("v", lambda x: F.abs(x) > 1e15)  # beyond what floor() gives as a 64-bit number
    rough = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") * scale, F.lit(2.0))) * 1.0001
    rows = rows.withColumn("length", F.sqrt(F.when(far, rough).otherwise(F.aggregate("v", F.lit(0.0), square))))
    points = [i / GROUPS for i in range(1, GROUPS)]
    stats = rows.agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.percentile_approx("length", points, 10_000).alias("at")).first()
    seed = rows.orderBy(F.desc("length"), "id").limit(SEED_ROWS).select("id", "v").toPandas()
    held = spark.sparkContext.broadcast((seed["id"].to_numpy(np.int64), [np.asarray(v, np.float64) for v in seed["v"]]))
    # quantiles of the length part the rows into groups of like length, a group's rows are dealt to buckets by hash
    steps = max(1, min(GROUPS, stats["n"] // bucket))
    marks = [stats["at"][GROUPS * i // steps - 1] for i in range(1, steps)]
    edges = sorted(set(marks))
    above = [*edges, stats["longest"] or 0.0]  # no vector of a group is longer
    spans = [1, *[marks.count(e) for e in edges]]  # how many quantiles a group takes
    parts = [max(1, math.ceil(stats["n"] * m / steps / bucket)) for m in spans]
    group = lambda c, closed: F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda s, e: s + ((c >= e) if closed else (c > e * (1 + 1e-9))).cast("int")) if edges else F.lit(0)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, listed = held.value
        own = matrix(pa.array(listed, pa.list_(pa.float64())))
        for batch in batches:
            asking = matrix(batch.column(1), own.shape[1])
            seeds, asking = Whole(wide(own, asking.shape[1]), scale), Whole(asking, scale)
            out = []
            for q, i in enumerate(batch.column(0).to_pylist()):
                scores = seeds.dots(np.flatnonzero(ids != i), asking, q)
                out.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else LEAST)
            reach = np.where(np.array(out, float) > 0, np.array(out, float) / np.maximum(asking.lengths, 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), pa.array(reach)], ["id", "v", "floor", "reach"])

    single = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(single.mapInArrow(floors, f"id long, v {form}, floor long, reach double").withColumn("class", group(F.col("reach"), False)), "asked")
    in_class = {r["class"]: r["n"] for r in asked.groupBy("class").agg(F.count("*").alias("n")).collect()}
    blocks = [math.ceil(in_class.get(c, 0) / block) for c in range(len(above))]
    before = [sum(blocks[:c]) for c in range(len(above) + 1)]
    of = lambda numbers, c: F.get(F.array(*map(F.lit, numbers)), c)
    left = rows.withColumn("group", group(F.col("length"), True)).where(of(before[1:], F.col("group")) > 0)
    left = left.select("id", "v", "group", F.pmod(F.xxhash64("id", "v"), of(parts, F.col("group"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), of(before[1:], F.col("group")) - 1)).alias("block"))
    right = asked.select("id", "v", "floor", (of(before, F.col("class")) + F.pmod(F.xxhash64("id"), of(blocks, F.col("class")))).cast("int").alias("block"), F.explode(F.sequence(F.col("class"), F.lit(len(edges)))).alias("group"))
    right = right.select("id", "v", "floor", "block", "group", F.explode(F.sequence(F.lit(0), of(parts, F.col("group")) - 1)).alias("part"))

    def cell(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if candidates.num_rows and questions.num_rows:
            rows_, asked_ = matrix(candidates["v"]), matrix(questions["v"])
            width = max(rows_.shape[1], asked_.shape[1])
            order = np.argsort(-Whole(rows_, scale).lengths, kind="stable")
            rows_, asked_ = Whole(wide(rows_[order], width), scale), Whole(wide(asked_, width), scale)
            found = search_bucket(candidates["id"].to_numpy()[order], rows_, questions["id"].to_numpy(), asked_, questions["floor"].to_numpy(), k)
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ["group", "part", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
