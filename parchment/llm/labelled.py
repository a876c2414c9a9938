"""A bounded sample of labelled documents to fit a classifier on, and the rows held out of it."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = TypeVar("Model")


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True for ids whose crc32 (of the id as text; null: empty text) leaves the remainder."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def allowed(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """doc_id, y of all rows that may be learned from."""
    rows = labels.select(F.col("doc_id"), F.col(label).alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder)).distinct()


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, max_chars: int) -> DataFrame:
    """Up to per_class rows (doc_id, text, y) of either label, least hash of the id first, never a held-out one.

    Only whole texts of up to max_chars characters are taken. Both bounds hold at every size of the input, so the ids
    can be broadcast and the texts fit one task.
    """
    known = allowed(labels, label, modulus, remainder)
    whole = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    order = [F.xxhash64("doc_id", F.lit(label)), "doc_id"]
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return whole.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "text", "y")


def fitted(rows: DataFrame, train: Callable[[list[tuple[str, int]]], Model]) -> tuple[Model, tuple[int, int]]:
    """train((text, label), ...) over a bounded sample, in a task of its own, and how many rows of either label it had; the
    same rows in the same order each time."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(int(i), int(y), t) for b in batches for i, t, y in zip(b.doc_id, b.text, b.y)]
        held.sort()
        n = sum(y for _, y, _ in held)
        yield pd.DataFrame({"model": [pickle.dumps(train([(t, y) for _, y, t in held]))], "zeros": [len(held) - n], "ones": [n]})

    found = rows.repartition(1).mapInPandas(over, "model binary, zeros long, ones long").first()
    return (train([]), (0, 0)) if found is None else (pickle.loads(found["model"]), (found["zeros"], found["ones"]))


def shift(labels: DataFrame, label: str, modulus: int, remainder: int, had: tuple[int, int]) -> float:
    """What a sample that had so many rows of either label lacks of the log odds of label 1 among all allowed rows: a bound on
    the rows of a label must not make a label likelier the larger the input is."""
    n = {r["y"]: r["count"] for r in allowed(labels, label, modulus, remainder).groupBy("y").count().collect()}
    if not (n.get(0) and n.get(1) and all(had)):
        return 0.0
    return math.log(n[1] / n[0]) - math.log(had[1] / had[0])
