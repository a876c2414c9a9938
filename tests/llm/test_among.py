"""among() loses no row whose key is wanted, and leaves out nearly all others."""

import pytest
from pyspark.sql import functions as F

from parchment.sources import scratch


def test_wanted_rows_stay(spark):
    rows = spark.range(-20_000, 20_000).withColumnRenamed("id", "k").withColumns({"_piece": F.lit("a"), "_map": F.lit("b"), "id": F.lit(0)})
    rows = rows.unionByName(rows.limit(5).withColumn("k", F.lit(None).cast("long")))
    ids = spark.range(-1000, 1000).select((F.col("id") * 19).alias("id"))
    got = scratch.among(rows, "k", ids)
    assert got.columns == rows.columns and {*got.select("_piece", "_map").distinct().collect()} == {("a", "b")}
    found = {r.k for r in got.select("k").collect()}
    assert {r.id for r in ids.collect()} <= found and len(found) < 5500
    assert scratch.among(rows, "k", ids.limit(0)).count() == 0


@pytest.mark.parametrize("bits,least", [(11, 2001), (10, 4000)])
def test_bound(spark, monkeypatch, bits, least):
    """A map that is full lets rows through; one with more ids than bits is left out."""
    monkeypatch.setattr(scratch, "MAP_BITS", bits)
    rows, ids = spark.range(4000).toDF("k"), spark.range(2000)
    found = {r.k for r in scratch.among(rows, "k", ids).collect()}
    assert {*range(2000)} <= found and len(found) >= least
