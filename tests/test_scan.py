"""Scans in slices against one window over the whole key, most rows in one key."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.operators import budget, findings, locate, scan


def windows_without_slices(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "windowspecdefinition" in x and "_slice" not in x and "_k_slice" not in x]


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_running(spark, slices):
    rng = random.Random(slices)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), rng.choice([None, *range(200)]), i, rng.choice([None, rng.randrange(1000)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at long, tie long, v long")
    for before in (False, True):
        got = scan.running(scan.sliced(df, "at", slices=slices), ["k"], ["at", "tie"], {"m": ("max", "v"), "s": ("sum", "v"), "l": ("last", "v")}, before=before)
        w = W.partitionBy("k").orderBy("at", "tie").rowsBetween(W.unboundedPreceding, -1 if before else 0)
        want = df.withColumns({"m": F.max("v").over(w), "s": F.sum("v").over(w), "l": F.last("v", ignorenulls=True).over(w)})
        assert sorted(map(str, got.drop("_slice").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(("kind", "make"), [("string", lambda i: f"VT-{i:03d}"), ("timestamp", None), ("double", float)])
def test_orders(spark, kind, make):
    column = F.timestamp_micros(F.col("id") * 1000) if kind == "timestamp" else F.col("id").cast("double") if kind == "double" else F.format_string("VT-%03d", "id")
    df = scan.sliced(spark.range(1500).select(column.alias("at")), "at", slices=16)
    got = [(r["at"], r["_slice"]) for r in df.collect()]
    assert [s for _, s in sorted(got)] == sorted(s for _, s in got) and (kind == "string" or len({s for _, s in got}) > 8)


def test_spans_of_one_key(spark):
    rng = random.Random(2)
    rows = [("p", s, s + rng.randrange(30), i) for i in range(800) for s in [rng.randrange(9000)]]
    got = sorted((r["start"], r["end"], r["n"]) for r in budget.merged_spans(spark.createDataFrame(rows, "k string, start long, end long, pos long"), ["k"]).collect())
    want = []
    for _, s, e, _ in sorted(rows, key=lambda r: (r[1], r[3])):
        if want and s <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
        else:
            want.append((s, e, 1))
    assert got == want and 100 < len(want) < 800


def test_as_of_and_headers_of_one_key(spark):
    rng = random.Random(5)
    events = [("u", rng.randrange(5000), i) for i in range(700)]
    marks = [("u", t, f"m{t}") for t in rng.sample(range(5000), 60)]
    e, m = spark.createDataFrame(events, "k string, t long, id long"), spark.createDataFrame(marks, "k string, since long, mark string")
    done = locate.as_of(e, m, "k", "t", "since", "mark")
    for r in done.collect():
        assert r["as_of_mark"] == max(((t, v) for _, t, v in marks if t <= r["t"]), default=(0, None))[1]
    found = [("p", f"VT-{i:03d}", rng.choice(["risk", "language", None])) for i in range(1, 1200)]
    rows = findings.report_rows(spark.createDataFrame(found, "project_id string, code string, group_key string"))
    got = sorted((r["code"], r["header"]) for r in rows.collect())
    order = sorted(found, key=lambda x: x[1])
    assert got == [(c, k == 0 or g != order[k - 1][2]) for k, (_, c, g) in enumerate(order)]
    assert windows_without_slices(done) == [] and windows_without_slices(rows) == []
