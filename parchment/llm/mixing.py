"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

Sources stand in code point order, null last. Each wants its weight's part of the total; one that wants more than
max_epochs times its size stops there, and what is over goes to the others by weight until none is above. A document is
then taken floor(target / size) times, and once more if it lies in the fractional part of its source's seeded order; the
document at the cut gives only its first words. So each source gives its target to the word, no document is taken more
than max_epochs times (rounded up to whole passes), and reruns agree. Ties in the order go by size, then by a hash of the
text; rows that are equal in these share the words that are left for them, in whole words each. A null text has size 0
and is taken as often as its source says, with no words; texts of any length are counted whole; an empty table stays
empty. Extra columns are kept, those with an output's name replaced.

Texts are never shuffled. One scan writes a narrow table of sizes and places in the seeded order; from it come the sources'
targets and, slice by slice of the order, the one place where each source's fraction ends. A second scan compares each
document with its source's place. A source may hold most rows: it is summed in slices, and only the slice that holds the
cut is ordered document by document. The table of sources, one row each, is ordered as a whole and read back from a
stored table, so that Spark sends it to all tasks only if its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.llm.common import apart, quoted, stored, words

WEIGHTS = (3.0, 1.0, 2.0)
SLICE_DIGITS = 3  # 4,096 slices
OUTPUTS = ("size", "source_size", "target", "taken")


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size) with weight, target. The level is found where the caps, ordered by cap / weight, meet it.

    The sources are ordered in one task: memory and time are bounded by their number, one row each.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place)).withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = W.orderBy("_ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_nth", F.row_number().over(by_ratio))
    all_ = W.partitionBy()
    total = F.sum("source_size").over(all_) * F.lit(share)
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source, in this order, that its level leaves below its cap sets the level for it and all after it
    level = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_nth", "_level"))).over(all_)["_level"]
    s = s.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap"))))
    return s.drop("_cap", "_ratio", "_level", "_nth")


def ends(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """sizes (source, size, u, tie), a stored table. For each source: source_size, target, whole (times that every document
    is taken), and where the last pass ends: documents up to (u, size, tie) are taken once more, those there by `part` words."""
    cut_at = F.substring("u", 1, SLICE_DIGITS)
    slices = sizes.groupBy("source", cut_at.alias("slice")).agg(F.sum("size").alias("slice_size"))
    plan = water_fill(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("cut", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
    plan = stored(plan.select("source", "source_size", "target", "whole", "cut"), "targets")
    own = lambda df, like: df.withColumnRenamed("source", "_s").join(like, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    so_far = lambda size, *keys: F.sum(size).over(W.partitionBy("source").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0))
    upto = slices.withColumn("upto", so_far("slice_size", "slice"))
    cuts = own(upto, plan.select("source", "cut")).where((F.col("cut") <= F.col("upto")) & (F.col("cut") > F.col("upto") - F.col("slice_size")))
    cuts = stored(cuts.select("source", "slice", (F.col("cut") - F.col("upto") + F.col("slice_size")).alias("left")), "cuts")
    inside = own(sizes.withColumn("at", cut_at), cuts).where(F.col("at") == F.col("slice"))
    equal = inside.groupBy("source", "left", "u", "size", "tie").agg(F.count("*").alias("n"))
    equal = equal.withColumn("words", F.col("n") * F.col("size")).withColumn("upto", so_far("words", "u", "size", "tie"))
    last = equal.where((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("words")))
    part = F.floor((F.col("left") - F.col("upto") + F.col("words")) / F.col("n")).cast("bigint")
    point = last.select(F.col("source").alias("_s"), F.struct("u", "size", "tie").alias("point"), part.alias("part"))
    return stored(plan.drop("cut").join(point, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "ends")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target and taken (words, repeats counted)."""
    keep, own = apart(docs, OUTPUTS)
    size = F.size(words(F.col(text))).cast("bigint")
    u = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    tie = F.xxhash64(text)
    sizes = stored(docs.select(F.col(source).alias("source"), size.alias("size"), u.alias("u"), tie.alias("tie")), "sizes")
    found = ends(sizes, weights, share, max_epochs)
    found = found.select(*[F.col(c).alias(own(c)) for c in found.columns])
    rows = docs.select(*keep, F.col(source).alias(own("of")), F.struct(u.alias("u"), size.alias("size"), tie.alias("tie")).alias(own("place")))
    rows = rows.join(found, F.col(own("of")).eqNullSafe(F.col(own("source"))))
    n, place, point = F.col(own("place"))["size"], F.col(own("place")), F.col(own("point"))
    more = F.when(place < point, n).when(place == point, F.col(own("part"))).otherwise(F.lit(0))
    return rows.select(*keep, n.alias("size"), F.col(own("source_size")).alias("source_size"), F.col(own("target")).alias("target"), (F.col(own("whole")) * n + more).cast("bigint").alias("taken"))


def repeat(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The documents as the mix takes them: whole copies, then the first words of a copy that is cut, joined by one space.

    Documents without words stay once.
    """
    taken, size = F.col("taken"), F.col("size")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(1)).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0)).cast("int")
    copies: Column = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    first = apart(mixed)[1]("first")
    cut = F.when(F.col(first) < 0, F.col(text)).otherwise(F.array_join(F.slice(words(F.col(text)), 1, F.greatest(F.col(first), F.lit(1))), " "))
    out = mixed.select("*", F.explode(copies).alias(first)).withColumn(text, cut)
    return out.select(*map(quoted, columns))
