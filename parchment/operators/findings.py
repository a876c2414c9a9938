"""Review findings: first-wins dedup, classing, cap, numbers, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions import naming
from parchment.functions.text import dedupe_key, is_blank, truncate
from parchment.operators import scan

MAX_RISK = 10
#: Rows of a project numbered in one slice; a project of any size spreads over slices.
SLICE = 4096


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least order for each key. A least-of aggregate, combined before the shuffle, so that a key of many rows is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def numbered(rows: DataFrame, project: str, order: str, to: str = "nth") -> DataFrame:
    """Adds the place (from 1) of each row in its project's order (a number).

    Rows are numbered in slices of the order and shifted by the slices before, so that a project with most of the rows
    is not one task's work.
    """
    cut = F.floor(F.col(order) / SLICE)
    counts = rows.groupBy(project, cut.alias("_slice")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(project).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnRenamed(project, "_project").drop("_n")
    own = rows.withColumn("_cut", cut).withColumn(to, F.row_number().over(W.partitionBy(project, "_cut").orderBy(order)))
    joined = own.join(counts, F.col(project).eqNullSafe(F.col("_project")) & F.col("_cut").eqNullSafe(F.col("_slice")))
    return joined.withColumn(to, F.col(to) + F.col("_before")).drop("_cut", "_slice", "_before", "_project")


def cap(rows: DataFrame, project: str, order: str, group: str = "risk", most: int = MAX_RISK) -> DataFrame:
    """Adds over_cap: true for rows of the group after its first `most` in the project."""
    first = rows.where(F.col("group_key") == group).withColumn("_nth", F.row_number().over(W.partitionBy(project).orderBy(order))).where(F.col("_nth") <= most)
    last = first.groupBy(project).agg(F.max(order).alias("_last"), F.count("*").alias("_n")).withColumnRenamed(project, "_project")
    joined = rows.join(last, F.col(project).eqNullSafe(F.col("_project")), "left")
    over = (F.col("group_key") == group) & (F.col("_n") == most) & (F.col(order) > F.col("_last"))
    return joined.withColumn("over_cap", F.coalesce(over, F.lit(False))).drop("_project", "_last", "_n")


def accept(records: DataFrame, most: int = MAX_RISK) -> DataFrame:
    """A model's findings (project_id, pos, types, refs, location, title, quote, scope, severity, file_key, bucket_key, expected,
    page_no) as they are kept: blank types go, repeats go, classes and enumerations are settled, risks are capped, codes run on."""
    typed = records.where(~is_blank(F.col("types"))).withColumn("dedupe_key", dedupe_key(*map(F.col, ("types", "refs", "location", "title", "quote"))))
    single = first_wins(typed, ["project_id", "dedupe_key"], "pos").withColumn("group_key", naming.group_of(F.col("types")))
    kept = numbered(cap(single, "project_id", "pos", most=most).where("NOT over_cap").drop("over_cap"), "project_id", "pos")
    return kept.select(
        "project_id",
        "pos",
        F.format_string("VT-%03d", F.col("nth")).alias("code"),
        "types",
        "group_key",
        naming.scope(F.col("scope")).alias("scope"),
        naming.severity(F.col("severity")).alias("severity"),
        naming.file_key(F.col("file_key")).alias("file_key"),
        naming.default_bucket(F.col("group_key"), F.col("bucket_key")).alias("bucket_key"),
        "title",
        truncate(F.col("quote"), 480).alias("quote"),
        truncate(F.col("refs"), 500).alias("refs"),
        truncate(F.col("location"), 500).alias("location"),
        truncate(F.col("expected"), 500).alias("expected"),
        "page_no",
    )


def run_counts(records: DataFrame, most: int = MAX_RISK) -> DataFrame:
    """For each project: rows said, blank, repeated, over the cap."""
    typed = records.withColumn("blank", is_blank(F.col("types"))).withColumn("dedupe_key", dedupe_key(*map(F.col, ("types", "refs", "location", "title", "quote"))))
    single = first_wins(typed.where("NOT blank"), ["project_id", "dedupe_key"], "pos").withColumn("group_key", naming.group_of(F.col("types")))
    per = cap(single, "project_id", "pos", most=most).groupBy("project_id").agg(F.count("*").alias("distinct"), F.count_if("over_cap").alias("over_cap"))
    said = typed.groupBy("project_id").agg(F.count("*").alias("said"), F.count_if("blank").alias("blank"))
    out = said.join(per, "project_id", "left").na.fill(0, ["distinct", "over_cap"])
    return out.select("project_id", "said", "blank", (F.col("said") - F.col("blank") - F.col("distinct")).alias("repeated"), "over_cap")


def metrics(findings: DataFrame) -> DataFrame:
    """For each project the findings of each group, all, and those across files."""
    counts = [F.count_if(F.col("group_key") == g).alias(g) for g in naming.GROUPS]
    return findings.groupBy("project_id").agg(*counts, F.count("*").alias("total"), F.count_if(F.col("scope") == "inter").alias("cross_file"))


def count_of(group: Column) -> Column:
    """The count of a row's group among the columns of metrics()."""
    return F.coalesce(*[F.when(group == g, F.col(g)) for g in naming.GROUPS])


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings in order of their codes with `header`: true where the group differs from the one before. The row before is
    looked up in slices of the order, so a project may hold all rows."""
    held = F.struct(F.col("group_key").alias("g"))  # a value even where the group is null
    rows = scan.running(scan.sliced(findings, "code"), ["project_id"], ["code"], {"_before": ("last", held)}, before=True)
    return rows.withColumn("header", F.col("_before").isNull() | ~F.col("group_key").eqNullSafe(F.col("_before.g"))).drop("_before", "_slice")
