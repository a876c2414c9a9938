"""Messages of failures are limited before they are gathered."""

from parchment.operators import merge


def test_five_failures_of_many(spark):
    rows = [(p, i, None if i == 3 else f"f{i}", "FAILED" if i % 2 else "PARSED") for p in ("a", None) for i in range(40)] + [("b", 1, "x", "PARSED")]
    df = merge.parse_summary(spark.createDataFrame(rows, "project_id string, id long, file_name string, parse_status string"))
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    said = "f1 failed; f5 failed; f7 failed; f9 failed"
    assert {tuple(r) for r in df.collect()} == {("a", 40, 20, 20, said), (None, 40, 20, 20, said), ("b", 1, 1, 0, "")}
