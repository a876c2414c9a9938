"""Connected components of links, by alternating large and small stars until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import forget, stored


def _star(links: DataFrame) -> DataFrame:
    """links (hi, lo): each hi's other neighbours below it, and hi itself, then hang on the least of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = links.join(least, "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("least").alias("lo")))


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least of the node and all its neighbours."""
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("at", "to")
    least = both.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("least"))
    return both.where("to > at").join(least, "at").select(F.col("to").alias("hi"), F.col("least").alias("lo"))


def components(links: DataFrame) -> DataFrame:
    """links: two columns of ids. Returns node, root (the least id reachable) for each node that is not its own root.

    Links to oneself or null count for nothing. Minima are taken by aggregates and joined back, so that no node's
    neighbours meet in one value. Each round is a table in the shared folder; rounds grow with the logarithm of the
    longest path.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), (F.col(a) != F.col(b)).alias("_ok")).where("_ok").select("hi", "lo").distinct()
    now, before = stored(links, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        after = stored(_star(_large(now).distinct()).distinct(), "links")
        forget(now)
        now, before = after, mark
