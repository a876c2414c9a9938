"""Needles by their keys against find_loose() on every pair."""

import random

import numpy as np

from pyspark.sql import functions as F

from parchment.functions.text import find_loose
from parchment.operators import grams, locate

LETTERS = ["ab ", "aB\n c", "ßẞsS", "iIİı", "σςΣ", "kKK", "ſs", "éÉ e", "  x", "ﬁfi"]


def rows(seed, n, longest):
    rng = random.Random(seed)
    return [(i, f"p{rng.randrange(2)}", "".join(rng.choice(rng.choice(LETTERS[: 1 + seed % len(LETTERS)] + ["abc"])) for _ in range(rng.randrange(longest)))) for i in range(n)]


def test_all_pairs(spark):
    for seed in range(4):
        docs = spark.createDataFrame(rows(seed * 3, 60, 60), "doc_id long, project string, text string").withColumn("place", F.lit(0))
        asked = spark.createDataFrame(rows(seed * 3 + 1, 60, 9), "finding_id long, project string, needle string").where(F.trim("needle") != "")
        every = asked.join(docs, "project").where(find_loose(F.col("text"), F.col("needle")) >= 0).select("needle", "project", "doc_id").distinct()
        pairs = grams.candidates(asked.select("project", "needle").distinct(), docs, ["project"]).select("needle", "project", "doc_id")
        assert every.exceptAll(pairs).count() == 0 and pairs.count() == pairs.distinct().count()
        _, held = locate._hits(asked.select("finding_id", "project", F.array("needle").alias("needles")), docs, ["project"])
        want = {tuple(r) for r in every.where(F.regexp_replace("needle", r"^[\x00-\x20]+|[\x00-\x20]+$", "") != "").collect()}
        assert {(r["needle"], r["project"], r["doc_id"]) for r in held.collect()} == want and len(want) > 20


def test_within(spark):
    """A finding that names a file is looked for in that file, one that doesn't in all of the project."""
    docs = spark.createDataFrame([(1, "p", "A", "the clause says so"), (2, "p", "B", "The Clause\nsays so"), (3, "q", "A", "the clause says so")], "doc_id long, project_id string, file_key string, text string")
    asked = spark.createDataFrame([("x", "p", "B", ["clause says"]), ("y", "p", None, ["nowhere", "clause  says"]), ("z", "q", "B", ["clause"]), ("w", "q", None, [" "])], "finding_id string, project_id string, file_key string, needles array<string>")
    got = {r["finding_id"]: (r["doc_id"], r["index"]) for r in locate.first_place(asked, docs, ["project_id"], within="file_key").collect()}
    assert got == {"x": (2, 3), "y": (1, 3)}
    firsts = [(r["finding_id"], r["rank"], r["doc_id"]) for r in locate.first_documents(asked, docs, ["project_id"], within="file_key").collect()]
    assert sorted(firsts) == [("x", 1, 2), ("y", 1, 1), ("y", 2, 2)]


def test_one_gram_that_all_texts_have(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("p").alias("project"), F.concat(F.lit("common words "), F.col("id").cast("string")).alias("text"), F.lit(0).alias("place"))
    asked = spark.createDataFrame([(1, "p", ["words 17"]), (2, "p", ["common words"]), (3, "p", ["absent"])], "finding_id long, project string, needles array<string>")
    _, held = locate._hits(asked, docs, ["project"])
    counts = {r["needle"]: r["n"] for r in held.groupBy("needle").agg(F.count("*").alias("n")).collect()}
    assert counts == {"words 17": 111, "common words": 3000}
    # the key of a needle is its rarest gram: few texts are asked for "words 17"
    pairs = grams.candidates(spark.createDataFrame([("p", "words 17")], "project string, needle string"), docs, ["project"])
    assert pairs.count() < 400


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, project string, text string")
    asked = spark.createDataFrame([], "finding_id long, project string, needles array<string>")
    assert locate.first_place(asked, docs, ["project"]).collect() == []


def test_first_documents_whose_form_alone_is_equal(spark):
    """Documents whose folded text has the needle but that don't hold it come first: the next ones count."""
    fillers = [(i, "p", "xx İ yy") for i in range(5)]
    docs = spark.createDataFrame([*fillers, (7, "p", "here xx iyy"), (8, "p", "xx i  yy"), (9, "q", "xxiyy")], "doc_id long, project string, text string")
    asked = spark.createDataFrame([(1, "p", ["xxiyy"]), (2, "p", ["　xx　iyy"])], "finding_id long, project string, needles array<string>")
    every = [r[0] for r in docs.where((F.col("project") == "p") & (find_loose(F.col("text"), F.lit("xxiyy")) >= 0)).orderBy("doc_id").select("doc_id").collect()]
    got = sorted((r["finding_id"], r["rank"], r["doc_id"]) for r in locate.first_documents(asked, docs, ["project"]).collect())
    assert [d for f, _, d in got if f == 1] == every[:3] and 0 not in every
    assert [r["doc_id"] for r in locate.first_place(asked, docs, ["project"]).where("finding_id = 1").collect()] == every[:1]


def test_keys_in_texts():
    """Every needle that a text holds, of any length, across slices and ends of texts; no other."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé😀") for _ in range(rng.randrange(700))) for _ in range(30)] + ["", "a"]
    needles = sorted({t[a : a + rng.choice([1, 2, 5, 7, 9, 30, 70, 200, 600])] for t in texts if t for a in (rng.randrange(len(t)) for _ in range(9))} | {"zz", "é" * 9})
    n, keys, heads = grams.keys_of(needles, np.full(len(needles), 3))

    def bits(values, size):
        out = np.zeros(1 << size, np.uint8)
        out[(values.view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)] = 1
        return out

    for size in (64, 1 << 15):
        grams.SLICE, before = size, grams.SLICE
        docs, found = grams.keys_in(texts, np.full(len(texts), 3), sorted({*n.tolist()}), bits(heads, 18), np.packbits(bits(keys, 22), bitorder="little"))
        grams.SLICE = before
        got = {*zip(docs.tolist(), found.tolist())}
        assert len(got) == len(docs)
        assert all(((i, k) in got) == (x in t) for i, t in enumerate(texts) for x, k in zip(needles, keys.tolist()))


def test_common_grams_of_a_rare_needle(spark):
    """All texts have each five characters of the needle, one has the needle: one is asked."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("p").alias("project"), F.when(F.col("id") == 77, "abcdefghijkl").otherwise("abcdefgh efghijkl").alias("text"), F.lit(0).alias("place"))
    pairs = grams.candidates(spark.createDataFrame([("p", "abcd EFGHijkl")], "project string, needle string"), docs, ["project"])
    assert [r["doc_id"] for r in pairs.collect()] == [77]
