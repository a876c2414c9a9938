"""Where documents hold what a finding quotes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.text import excerpt, find_loose, is_blank, loose_at, page_in, page_marks, trim
from parchment.operators import grams, scan
from parchment.sources.scratch import sent, stored


#: Candidate needles that a text is asked for together.
TOGETHER = 256


def _scope(on: list[str], within: str | None) -> list[str]:
    return [*on, *([within] if within else [])]


def _holding(pairs: DataFrame, docs: DataFrame, on: list[str], within: str | None) -> DataFrame:
    """Of a stored table of pairs (doc_id, place, needle and its scope) those whose text holds the needle. A text goes to its needles once
    for each TOGETHER of them."""
    of = F.struct(*([within] if within else []), "needle")
    one = F.struct(of.alias("of"), trim(F.col("needle")).alias("pin"), F.lower(trim(F.col("needle"))).alias("as_is"))
    at = ["doc_id", "place", *on]
    sizes = pairs.groupBy(*at).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_lists"))
    lists = pairs.join(sizes, at).groupBy(*at, F.pmod(F.xxhash64("needle"), "_lists").alias("_list")).agg(F.collect_list(one).alias("_needles"))
    flat = sent(docs, pairs, at).where(~is_blank(F.col("text"))).select(*at, "text", F.lower("text").alias("_as_is"))
    # as find_loose() has it: as it is but for case, else whatever white space
    holds = lambda x: F.contains(F.col("_as_is"), x["as_is"]) | (loose_at(F.col("text"), x["pin"]) >= 0)
    found = F.transform(F.filter("_needles", holds), lambda x: x["of"])
    # an outer generator: Spark would compute the array of another one a second time, for a filter on its size
    held = flat.join(lists, at).select(*at, F.explode_outer(found).alias("_of")).where(F.col("_of").isNotNull())
    return held.select(*at, "_of.*")


def _hits(findings: DataFrame, docs: DataFrame, on: list[str], within: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """findings (finding_id, needles, *on) against docs (doc_id, place, text, *on): needles of findings, and which documents hold them.

    Each distinct needle of a project is looked for once, whoever asks for it, in the texts that have its key (`grams`). within: a
    column of both; a needle that has a value there is looked for in documents of that value alone. most: the first documents
    of each needle, by place and id, that hold it, this many at least, if there are so many: texts are compared with needles that
    they are among the first to have; only if one of these doesn't hold its needle, as its form is the same but not its letters, are
    all documents asked for that needle.
    """
    scope = _scope(on, within)
    asked = findings.select("finding_id", *scope, F.posexplode("needles").alias("needle_pos", "needle")).where(~is_blank(F.col("needle")))
    distinct = asked.select(*scope, "needle").distinct().withColumnsRenamed({within: "_within"} if within else {})

    def narrowed(pairs: DataFrame) -> DataFrame:
        if within:
            pairs = pairs.where(F.col("_within").isNull() | (F.col("_within") == F.col(within))).drop(within).withColumnRenamed("_within", within)
        return pairs

    if most is None:
        return asked, _holding(stored(narrowed(grams.candidates(distinct, docs, on)), "candidates"), docs, on, within)
    keys = grams.keyed(distinct, on)
    first = lambda rows, *by: rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("place", "doc_id"))).where(F.col("_k") <= most).drop("_k")
    few = first(grams.held_keys(keys, docs, on), *scope, "_key").join(keys.drop("_n", "_head"), [*on, "_key"]).drop("_key")
    pairs = stored(first(narrowed(few), *scope, "needle"), "candidates")
    held = stored(_holding(pairs, docs, on, within), "held")
    # (groups take null for a value, joins don't)
    both = pairs.select(*scope, "needle", F.lit(1).alias("n")).unionByName(held.select(*scope, "needle", F.lit(-1).alias("n")))
    short = stored(both.groupBy(*scope, "needle").agg(F.sum("n").alias("n")).where("n > 0").drop("n"), "short")
    if short.isEmpty():
        return asked, held
    every = narrowed(grams.candidates(short.withColumnsRenamed({within: "_within"} if within else {}), docs, on))
    return asked, held.unionByName(_holding(stored(every, "candidates"), docs, on, within)).distinct()


def _shown(places: DataFrame, docs: DataFrame, on: list[str]) -> DataFrame:
    """places with the index, the page and what stands around; a needle's place in a document is looked at once, whoever asks for it."""
    text, index, at = F.col("text"), F.col("index"), ["doc_id", *on]
    places = stored(places, "places")
    # lower case and markers: once for a text, not for each needle
    known = sent(docs, places, at).select(*at, "text", F.lower("text").alias("_low"), page_marks(text).alias("_marks"))
    joined = places.select(*at, "needle").distinct().join(known, at).withColumn("index", find_loose(text, F.col("needle"), F.col("_low")))
    seen = joined.withColumn("page", page_in(F.col("_marks"), index)).withColumn("excerpt", excerpt(text, index)).drop("text", "_low", "_marks")
    return places.join(seen, [*at, "needle"]).drop("needle")


def _placed(docs: DataFrame) -> DataFrame:
    return docs if "place" in docs.columns else docs.withColumn("place", F.lit(0))


def _asked_at(asked: DataFrame, held: DataFrame, scope: list[str]) -> DataFrame:
    """asked with the columns of held, rows of the same scope and needle."""
    other = held.withColumnsRenamed({c: f"_{c}" for c in (*scope, "needle")})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*scope, "needle")])
    return asked.join(other, same).drop(*[f"_{c}" for c in (*scope, "needle")])


def first_place(findings: DataFrame, docs: DataFrame, on: list[str], within: str | None = None) -> DataFrame:
    """One place for each finding: the earliest needle that any document holds, in the document of least place (if docs have
    that column) and id. within: findings that have a value there are looked for in documents of that value alone."""
    scope = _scope(on, within)
    asked, held = _hits(findings, _placed(docs), on, within, 1)
    least = held.groupBy(*scope, "needle").agg(F.min(F.struct("place", "doc_id")).alias("_at"))
    own = _asked_at(asked, least, scope).groupBy("finding_id", *on).agg(F.min(F.struct("needle_pos", "_at.doc_id", "needle")).alias("_row"))
    return _shown(own.select("finding_id", *on, "_row.*"), docs, on).drop(*on)


def first_documents(findings: DataFrame, docs: DataFrame, on: list[str], most: int = 3, within: str | None = None) -> DataFrame:
    """The first documents, by place and id, that hold any needle; each with its place in the text.

    A document that is among a finding's first is among the first of each needle that it holds, so no more are kept.
    """
    scope = _scope(on, within)
    asked, held = _hits(findings, _placed(docs), on, within, most)
    few = held.withColumn("_k", F.row_number().over(W.partitionBy(*scope, "needle").orderBy("place", "doc_id"))).where(F.col("_k") <= most).drop("_k")
    each = _asked_at(asked, few, scope).groupBy("finding_id", "doc_id", "place", *on).agg(F.min(F.struct("needle_pos", "needle")).alias("_row"))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("finding_id").orderBy("place", "doc_id"))).where(F.col("rank") <= most)
    return _shown(ranked.select("finding_id", "doc_id", "rank", *on, "_row.*"), docs, on).drop(*on)


def as_of(events: DataFrame, marks: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each event with the value of its key's last mark at or before it: one union, one sort within slices of a key's time, what
    the slices before end with carried in; no join of ranges, and a key may hold all rows."""
    e = events.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).withColumn("_value", F.lit(None).cast(marks.schema[value].dataType))
    m = marks.select(F.col(key), F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    both = scan.sliced(e.unionByName(m, allowMissingColumns=True), "_at")
    done = scan.running(both, [key], ["_at", "_kind"], {f"as_of_{value}": ("last", "_value")})
    return done.where("_kind = 1").drop("_at", "_kind", "_value", "_slice")
