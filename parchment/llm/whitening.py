"""Whitening of vectors by their leading principal components, found by spectrum slicing.

One pass over the vectors gives exact sums of whole numbers, so the covariance is right to its last bit however far the
vectors lie from the origin. Its size is that of the dimension, not of the table, and its spectrum is sliced on the driver:
the inertia of V - sI, read from the blocks of a pivoted LDL' factorisation, says how many eigenvalues lie above s (Sylvester).
Bisection by these counts isolates each of the leading eigenvalues, or a cluster that is as good as one number; Rayleigh
quotient iteration, started inside, converges cubically; counts just below and just above the result certify its number.
A vector that has converged to another eigenvalue fails its certificate and is sought again in a halved interval.

Vectors that are null or hold null, NaN or an infinity take no part. A shorter vector, an empty one too, is filled with zeros
to the longest. Components become floor(scale * c) + offset; beyond 2**40 floor(scale * c) counts as 2**40. Rows are counted
as often as they occur; a null id stays. Components whose eigenvalue is zero up to rounding have no direction and no rows, so
one vector, or equal ones, give none, nor does an empty table. A deviation beyond 64 bits is given as the largest 64-bit number.
Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.topk import matrix, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
FAR = float(1 << 40)
MOST = (1 << 63) - 1
EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this share of the largest are kept orthogonal by force.
CLOSE = 1e-4


# ---- the spectrum of a symmetric matrix


@dataclass
class Factors:
    """P (A - sI) P' = L D L' with blocks of one or two rows in D."""

    order: np.ndarray
    lower: np.ndarray
    diagonal: np.ndarray
    below: np.ndarray  # below[k] != 0: rows k and k + 1 are one block

    def above(self) -> int:
        """How many eigenvalues lie above the shift: the positive ones of D."""
        n, k, found = len(self.diagonal), 0, 0
        while k < n:
            if self.below[k]:
                a, b, c = self.diagonal[k], self.below[k], self.diagonal[k + 1]
                det, trace = a * c - b * b, a + c
                found += 1 if det < 0 else 2 * (trace > 0)
                k += 2
            else:
                found += self.diagonal[k] > 0
                k += 1
        return int(found)

    def solve(self, b: np.ndarray) -> np.ndarray:
        n, x = len(b), b[self.order].astype(float)
        for k in range(n):
            x[k + 1 :] -= self.lower[k + 1 :, k] * x[k]
        k = 0
        while k < n:
            if self.below[k]:
                x[k : k + 2] = np.linalg.solve([[self.diagonal[k], self.below[k]], [self.below[k], self.diagonal[k + 1]]], x[k : k + 2])
                k += 2
            else:
                x[k] /= self.diagonal[k]
                k += 1
        for k in range(n - 1, -1, -1):
            x[k] -= self.lower[k + 1 :, k] @ x[k + 1 :]
        out = np.empty(n)
        out[self.order] = x
        return out


def factorise(a: np.ndarray, shift: float, tiny: float) -> Factors:
    """LDL' of a - shift * I. A pivot is the largest diagonal entry, or two rows around the largest entry off it where that is
    larger by the factor that bounds growth; pivots below `tiny` become `tiny`, a shift that far away."""
    m, n = a - shift * np.eye(len(a)), len(a)
    order, lower, diagonal, below = np.arange(n), np.eye(n), np.zeros(n), np.zeros(n)
    bound = (1 + 17**0.5) / 8

    def swap(i: int, j: int, done: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]
            lower[[i, j], :done] = lower[[j, i], :done]
            order[[i, j]] = order[[j, i]]

    k = 0
    while k < n:
        rest = m[k:, k:]
        at = int(np.argmax(np.abs(np.diagonal(rest))))
        on, off, r, c = abs(rest[at, at]), 0.0, 0, 0
        if k + 1 < n:
            free = np.abs(np.tril(rest, -1))
            r, c = divmod(int(np.argmax(free)), n - k)
            off = free[r, c]
        if on >= bound * off:
            swap(k, k + at, k)
            d = m[k, k] if abs(m[k, k]) > tiny else tiny
            diagonal[k] = d
            lower[k + 1 :, k] = m[k + 1 :, k] / d
            m[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], m[k, k + 1 :])
            k += 1
        else:
            swap(k, k + c, k)
            swap(k + 1, k + r, k)
            block = m[k : k + 2, k : k + 2].copy()
            diagonal[k : k + 2], below[k] = np.diagonal(block), block[0, 1]
            lower[k + 2 :, k : k + 2] = np.linalg.solve(block, m[k : k + 2, k + 2 :]).T
            m[k + 2 :, k + 2 :] -= lower[k + 2 :, k : k + 2] @ m[k : k + 2, k + 2 :]
            k += 2
    return Factors(order, lower, diagonal, below)


class Slicer:
    """The leading eigenvalues of a symmetric matrix without negative ones, and unit vectors of them."""

    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a)
        self.norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
        self.tiny = max(EPS * self.norm * 1e-2, 1e-300)
        #: Two numbers nearer than this can't be told apart in double precision.
        self.near = 8 * EPS * self.norm * max(1, self.n) ** 0.5
        self.seen: dict[float, int] = {}

    def above(self, s: float) -> int:
        if s not in self.seen:
            self.seen[s] = factorise(self.a, s, self.tiny).above()
        return self.seen[s]

    def isolate(self, number: int) -> tuple[float, float]:
        """An interval with eigenvalue `number` (from 1, falling) and no other, or too narrow to be cut."""
        low, high = -self.near, self.norm * (1 + 1e-9) + self.near
        for s, n in self.seen.items():  # counts taken before narrow the start
            if n >= number:
                low = max(low, s)
            else:
                high = min(high, s)
        while high - low > self.near and not self.above(high) == number - 1 == self.above(low) - 1:
            low, high = self.cut(low, high, number)
        return low, high

    def cut(self, low: float, high: float, number: int) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= number else (low, middle)

    def certified(self, value: float, number: int) -> bool:
        return self.above(value - self.near) >= number and self.above(value + self.near) < number

    def iterate(self, low: float, high: float, against: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from the middle of an interval, orthogonal to the vectors of the same cluster."""
        v = np.random.default_rng(seed).standard_normal(self.n)
        shift, last = (low + high) / 2, np.inf
        for step in range(40):
            v -= against.T @ (against @ v)
            v /= np.linalg.norm(v)
            if step > 1:  # two steps of inverse iteration lead into the interval
                shift = float(v @ self.a @ v)
                error = float(np.linalg.norm(self.a @ v - shift * v))
                if not low - self.near <= shift <= high + self.near:
                    shift = (low + high) / 2
                elif error <= 4 * EPS * self.norm or (error >= last and error <= self.near):
                    break
                last = error
            v = factorise(self.a, shift, self.tiny).solve(v)
            v /= np.abs(v).max()
        v -= against.T @ (against @ v)
        v /= np.linalg.norm(v)
        return float(v @ self.a @ v), v

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to k eigenvalues, falling, and unit vectors in rows; those that are zero up to rounding are left out."""
        values: list[float] = []
        vectors = np.zeros((0, self.n))
        for number in range(1, min(k, self.n) + 1):
            low, high = self.isolate(number)
            if high <= 8 * self.near:
                break
            first = sum(v > high + CLOSE * self.norm for v in values)  # rounding mixes in earlier ones that are near
            while True:
                value, vector = self.iterate(low, high, vectors[first:], number)
                if high - low <= self.near or (low <= value <= high and self.certified(value, number)):
                    break
                low, high = self.cut(low, high, number)
            if value <= 8 * self.near:
                break
            values.append(value)
            vectors = np.vstack([vectors, vector * np.sign(vector[np.argmax(np.abs(vector))])])
        return np.array(values), vectors


# ---- the table


@dataclass
class Whitener:
    """What a fit gives: sizes depend on the dimension alone."""

    n: int
    sums: list[int]  # of floor(scale * c)
    total: float  # variance of all components together
    values: np.ndarray
    vectors: np.ndarray
    scale: int = SCALE

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.total if self.total else self.values


def whole(vectors: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """Rows of floor(scale * c), as floats that hold whole numbers; the offset drops out of all that is centred."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix(vectors, width) * scale), -FAR, FAR)


def products(rows: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, whole numbers of any length."""
    most = float(np.abs(rows).max(initial=0.0))
    if most * most * len(rows) < 2.0**53:
        return (rows.T @ rows).astype(np.int64).astype(object)
    high = np.floor(rows / 2.0**20)
    low = rows - high * 2.0**20
    out = np.zeros((rows.shape[1], rows.shape[1]), object)
    for at in range(0, len(rows), 4096):  # 2**12 products of 2**40 at most
        h, l = high[at : at + 4096], low[at : at + 4096]  # noqa: E741
        hh, hl, ll = ((x.T @ y).astype(np.int64).astype(object) for x, y in ((h, h), (h, l), (l, l)))
        out += hh * (1 << 40) + (hl + hl.T) * (1 << 20) + ll
    return out


def usable_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    form = "array<float>" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "array<double>"
    return vectors.where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(form).alias("v"))


def fit(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> Whitener:
    """One scan; each task gives the sums of its rows, which Spark adds up by place. What comes to the driver is the covariance."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for batch in batches:
            rows = whole(batch.column(1), scale, len(one))
            if rows.shape[1] > len(one):
                held, (one, two) = (one, two), (np.zeros(rows.shape[1], object), np.zeros((rows.shape[1],) * 2, object))
                one[: len(held[0])], two[: len(held[0]), : len(held[0])] = held
            n += len(rows)
            one = one + rows.astype(np.int64).sum(axis=0).astype(object)
            two = two + products(rows)
        if n:
            i, j = np.triu_indices(len(one))
            # place -1 holds counts and sums
            places = [(-1, -1, n), *((-1, c, x) for c, x in enumerate(one)), *zip(i.tolist(), j.tolist(), two[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in places], pa.int32()), pa.array([p[1] for p in places], pa.int32()), pa.array([Decimal(int(p[2])) for p in places], pa.decimal128(38, 0))], ["i", "j", "x"])

    rows = usable_rows(vectors, key, vector)
    found = {(r["i"], r["j"]): int(r["x"]) for r in rows.mapInArrow(sums, "i int, j int, x decimal(38,0)").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()}
    n = found.get((-1, -1), 0)
    width = max((j for i, j in found if i == -1), default=-1) + 1
    one = [found[-1, j] for j in range(width)]
    cov = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            # a quotient of whole numbers is rounded once
            cov[i, j] = cov[j, i] = (n * found.get((i, j), 0) - one[i] * one[j]) / (n * n)
    values, basis = Slicer(cov).leading(components)
    return Whitener(n, one, float(np.trace(cov)), values, basis, scale)


def centred(rows: np.ndarray, model: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n, each rounded once, and the sums of (n x - S)**2, exact."""
    sums, n = model.sums, model.n
    most = float(np.abs(rows).max(initial=0.0)) * n + max(map(abs, sums), default=0)
    if most * most * max(1, rows.shape[1]) < 2.0**63 and most < 2.0**53:
        off = rows.astype(np.int64) * n - np.array(sums, np.int64)
        return off / n, (off * off).sum(axis=1)
    off = rows.astype(np.int64).astype(object) * n - np.array(sums, object)
    return (off / n).astype(float), np.array([min(MOST, sum(x * x for x in row)) for row in off], np.int64)


def whiten(vectors: DataFrame, model: Whitener, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (one number for each component) of each usable row."""
    turn = (model.vectors / np.sqrt(model.values)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, deviation = centred(whole(batch.column(1), model.scale, len(model.sums)), model)
            out = rows @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return usable_rows(vectors, key, vector).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitener) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured over all of them. Rows are centred as they
    are projected; what is left of their mean is taken off again. Tasks' sums are added as decimals, in any order the same."""
    k = len(model.values)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            one += rows.sum(axis=0)
            two += rows.T @ rows
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array([*[-1] * k, *i.tolist()], pa.int32()), pa.array([*range(k), *j.tolist()], pa.int32()), pa.array([*one, *two[i, j]])], ["i", "j", "x"])

    if not k:
        return 0.0
    parts = whitened.select("whitened").mapInArrow(sums, "i int, j int, x double")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(38,18)")).alias("x")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in found:
        if r["i"] < 0:
            mean[r["j"]] = float(r["x"]) / model.n
        else:
            cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = float(r["x"]) / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def components(vectors: DataFrame, k: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    model = fit(vectors, k, key, vector, scale)
    rows = whiten(vectors, model, key, vector)
    error = identity_error(rows, model)
    explained = F.array(*map(F.lit, model.explained.tolist())) if len(model.values) else F.array().cast("array<double>")
    one = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
