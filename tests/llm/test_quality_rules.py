import random
import re

from pyspark.sql import functions as F

from parchment.llm.quality_rules import LineRules, clean, failing
from tests.oracle import DATA

SCHEMA = "doc_id long, text string, kept string"
GOOD = "\n".join(" ".join(f"{w}{i}" for w in ("plain", "words", "that", "nobody", "would", "call", "strange", "at", "all")) + "." for i in range(8))


def brute(text: str | None) -> tuple[int, int]:
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(covered), len(lines) - len(set(lines))


def test_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "e\x0b", "\xa0f "]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "\n", "a b c a b c", "a a a a", "x"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in clean(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, _ in rows:
        assert (got[i].n_repeat_words, got[i].n_dup_lines) == brute(t)
        assert got[i].n_words == len((t or "").encode().split())
        assert got[i].word_chars == sum(len(w.decode()) for w in (t or "").encode().split())


def test_verdicts(spark):
    menu = "\n".join(["Home | News | Sport | More | Help"] * 3 + [f"Menu {i} | a | b | c | d | e | f | g | h | i | j | k" for i in range(8)])
    shout = " ".join(f"WORD{i}!!" for i in range(80))
    signs = " ".join(f"word{i}%%%" for i in range(80))
    half = GOOD + "\n" + "All rights reserved.\nHome | About | Contact | Terms"
    rows = [(1, GOOD, ""), (2, menu, ""), (3, shout, ""), (4, signs, ""), (5, half, ""), (6, "too short.", ""), (7, None, ""), (8, GOOD, "")]
    got = {r.doc_id: r for r in clean(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True}
    assert got[5].cleaned_text == GOOD and got[5].n_lines_failed == 2 and got[7].cleaned_text == ""


def test_long_text_and_empty_table(spark):
    text = " ".join(str(i % 50_000) for i in range(100_000))
    r = clean(spark.createDataFrame([(1, text, "")], SCHEMA)).first()
    assert r.n_words == r.n_repeat_words == 100_000 and r.base_failed
    assert clean(spark.createDataFrame([], SCHEMA)).count() == 0


NOTICES = """Licensed under the Apache License, Version 2.0.
This work is licensed under the GNU General Public License, version 3.
Released under the MIT License.
Licensed under CC BY-NC 4.0.
All rights reserved.
SPDX-License-Identifier: GPL-3.0-or-later
Made available under Creative Commons terms.
Ce texte est publié sous licence libre.
Distribué selon les termes de la licence publique générale.
Dieser Text ist unter CC BY-SA 4.0 verfügbar und lizenziert unter dieser.
Veröffentlicht unter der freien Dokumentationslizenz.
Este texto está publicado bajo la licencia MIT.
Distribuido bajo CC BY 4.0.""".split("\n")
PROSE = """He was released under the watch of his elder brother.
The driver showed a licence that had expired years ago.
Available under the counter were apples and old bread.
Sie steht unter der alten Brücke und wartet dort.
Vivía bajo la sombra de un árbol muy viejo y alto.
Il dormait sous la table de la grande cuisine.""".split("\n")


def test_notices(spark):
    lines = spark.createDataFrame([(x, n) for n, group in enumerate((NOTICES, PROSE)) for x in group], "line string, prose int")
    got = {r["line"]: r["why"] for r in lines.select("line", failing(F.col("line"), LineRules()).alias("why")).collect()}
    assert [x for x in NOTICES if got[x] != "boilerplate"] == [] and [x for x in PROSE if got[x]] == []


def test_planted_notices(spark):
    """Every line of the table that gives out a licence, or reserves rights, fails; they are gone from the cleaned texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    planted = lines.where(F.col("line").rlike("(?i)licen[cs]e|licenced|rights reserved|copyright")).withColumn("why", failing(F.col("line"), LineRules()))
    counts = {r["why"]: r["n"] for r in planted.groupBy("why").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"boilerplate"} and counts["boilerplate"] > 0
    left = [r["cleaned_text"] for r in clean(docs).select("cleaned_text").collect()]
    assert not any(re.search("(?i)licen[cs]e|rights reserved", t) for t in left)
