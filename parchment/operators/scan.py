"""Prefix scans of a key's rows in slices of its order, so that a key that holds most rows is not one task's work.

The order's first column is cut at quantiles of the whole table. Within a key and slice a window gives the running value; what the
slices before have come to is carried in from a small table, one row for each key and slice, scanned by itself. Rows that are equal in the
first column share a slice, so the columns behind it break ties inside; a slice is as large as the rows of one such value.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.sources.scratch import parts_for

#: Slices at most.
SLICES = 512


def number_of(c: Column, kind: T.DataType) -> Column:
    """A number in the order of a column's values: times by microseconds, strings by their first seven bytes."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), F.lit(1), F.lit(7))), 14, "0"), 16, 10).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    return c


def sliced(rows: DataFrame, order: str, to: str = "_slice", slices: int | None = None) -> DataFrame:
    """Adds the number of each row's slice; null comes first. One aggregate of the order's column comes before."""
    n = min(SLICES, slices or parts_for(rows.sparkSession))
    at = number_of(F.col(order), rows.schema[order].dataType)
    marks = rows.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10_000).alias("at")).first()["at"] if n > 1 else None
    edges = sorted({*(marks or [])})
    if not edges:
        return rows.withColumn(to, F.lit(0))
    # a balanced tree of comparisons: log n of them for a row
    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at < F.lit(edges[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return rows.withColumn(to, F.when(at.isNull(), -1).otherwise(place(0, len(edges))))


def running(rows: DataFrame, key: list[str], order: list[Column | str], values: dict[str, tuple[str, Column | str]], before: bool = False, slices: str = "_slice") -> DataFrame:
    """Adds, for each name, what its column has come to in the key's order up to the row (before: up to the row before it).
    The kinds are max, sum, and last (the last value that is not null). rows are sliced()."""
    within = W.partitionBy(*key, slices).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    fold = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    columns = {n: F.col(c) if isinstance(c, str) else c for n, (_, c) in values.items()}
    # the last row's value in a slice is that of the greatest place in it
    ranked = rows.withColumns({f"_v_{n}": c for n, c in columns.items()})
    if any(kind == "last" for kind, _ in values.values()):
        ranked = ranked.withColumn("_scan_nth", F.row_number().over(W.partitionBy(*key, slices).orderBy(*order)))
    own = ranked.withColumns({n: fold[kind](F.col(f"_v_{n}")).over(within) for n, (kind, _) in values.items()})
    total = {"max": lambda v: F.max(v), "sum": lambda v: F.sum(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("_scan_nth")))}
    ends = ranked.groupBy(*key, slices).agg(*[total[kind](F.col(f"_v_{n}")).alias(f"_t_{n}") for n, (kind, _) in values.items()])
    across = W.partitionBy(*key).orderBy(slices).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col(slices).alias("_k_slice"), *[fold[kind](F.col(f"_t_{n}")).over(across).alias(f"_c_{n}") for n, (kind, _) in values.items()])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], F.col(slices) == F.col("_k_slice"))
    both = own.join(carried, same)
    join = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "last": lambda a, b: F.coalesce(a, b)}
    done = both.withColumns({n: join[kind](F.col(n), F.col(f"_c_{n}")) for n, (kind, _) in values.items()})
    return done.drop("_k_slice", "_scan_nth", *[f"_k_{k}" for k in key], *[f"{m}{n}" for n in values for m in ("_v_", "_t_", "_c_")])
