import hashlib
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import phrases
from parchment.llm.phrases import FEW, KEPT, alike, compare_next, edited, fingerprints, labels, likeness, signatures, written
from parchment.llm.queries import QUERIES
from tests.oracle import DATA

M = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 32) * 0xBF58476D1CE4E5B9 & M
    return x ^ x >> 29


def toss(left, own):
    place = next((b for b in range(64) if (left ^ own) >> b & 1), 0)
    return 2 * place + (own >> place & 1)


def plain_labels(symbols):
    found = list(symbols)
    for _ in range(4):
        found = [toss(found[i - 1] if i else found[0] ^ 1, x) for i, x in enumerate(found)]
    return found


def plain(text):
    """Symbol by symbol, one text: its name, its signatures on each level."""
    now, levels = [ord(c) for c in text], []
    while now and (not levels or len(now) > 1):
        once = []
        for x in now:
            if once and once[-1][0] == x:
                once[-1][1] += 1
            else:
                once.append([x, 1])
        now = [x if n == 1 else mixed(x + 0xD6E8FEB86659FD93 * n & M) for x, n in once]
        label = plain_labels(now)
        begins = [i for i in range(len(now)) if i == 0 or (i + 1 < len(now) and label[i - 1] < label[i] > label[i + 1])]
        names = []
        for a, b in zip(begins, [*begins[1:], len(now)]):
            s = sum(mixed(now[i] + 0x9E3779B97F4A7C15 * (i - a + 1 + (len(levels) + 1 << 20)) & M) for i in range(a, b)) & M
            s = s * 0x94D049BB133111EB & M
            names.append(s ^ s >> 32)
        now = names
        levels.append(names)
    return now[0] if now else 0, levels


def plain_fingerprint(text):
    name, levels = plain(text)
    above = [x for names in levels[1:] for x in names]
    few = len(levels[1]) < FEW if len(levels) > 1 else True
    least = sorted({mixed(x) >> 32 for x in above + (levels[0] if few and levels else [])})[:KEPT]
    return written(name, np.array(least, np.uint32))


def texts(n=60):
    rng = random.Random(4)
    kinds = ("ab", "abcdefghij klmno ", "aaab", "é漢 字😀x")
    return ["", "a", "aa", "ab", "abc", *["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(400))) for _ in range(n)]]


def test_against_plain_version():
    own = texts()
    want = [plain_fingerprint(t) for t in own]
    assert [written(*x) for x in zip(*signatures(own))] == want
    assert [written(*(x[0] for x in signatures([t]))) for t in own] == want  # whatever else is in the batch
    assert len(set(want)) == len(set(own))


def test_labels_differ():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    found = labels(x, np.array([0, 700]))
    assert found.max() < 6 and (found[1:] != found[:-1])[np.arange(1, 5000) != 700].all()
    assert found[:700].tolist() == plain_labels(x[:700].tolist())


def test_shared_stretch_at_any_offset():
    """All first-level phrases of a shared stretch but those at its edges are the same, wherever it stands."""
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(600))
    for offset in range(12):
        a, b = plain("".join(rng.choice("xyz") for _ in range(offset)) + shared)[1], plain(shared)[1]
        for level, lost in ((0, 8), (1, 8), (2, 8)):
            assert len(set(b[level]) - set(a[level])) <= lost


def test_likeness():
    one, two = (1, np.arange(10, dtype=np.uint32)), (2, np.arange(5, 15, dtype=np.uint32))
    assert likeness(one, two) == 0.5 and likeness(one, one) == 1.0 and likeness(one, (3, np.zeros(0, np.uint32))) == 0.0
    rng = random.Random(3)
    for share in (0.1, 0.5, 0.9):  # of large sets, estimated
        a = {rng.randrange(1 << 32) for _ in range(3000)}
        b = {x for x in a if rng.random() < share}
        b |= {rng.randrange(1 << 32) for _ in range(3000 - len(b))}
        least = lambda s: np.array(sorted(s)[:1024], np.uint32)
        assert abs(likeness((1, least(a)), (2, least(b)), 1024) - 2 * len(a & b) / (len(a) + len(b))) < 0.06


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        t, o = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + o[: len(t) // 3]
        out.append((i, len(t), e, plain_fingerprint(t), plain_fingerprint(e)))
    return out


@pytest.mark.parametrize("n", [1, 2, 40])
def test_order_and_edits(spark, n):
    rng = random.Random(n)
    rows = [(i * 7, t) for i, t in enumerate((texts() + [None, "the end " * 50])[-n:])] if n > 2 else [(5, "abcdefghijkl"), (9, None)][:n]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).repartition(3)
    got = [tuple(r)[:5] for r in compare_next(df).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_odd_rows(spark):
    many = [(3, f"text {i} of one id") for i in range(50)] + [(4, "same text")] * 20 + [(None, "nobody"), (1, None), (2, "")]
    got = compare_next(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert len(got) == len(many) and [r["doc_id"] for r in got].count(3) == 50
    assert {r["fingerprint"] for r in got if r["doc_id"] == 4} == {plain_fingerprint("same text")}
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_chars"] == 0 and by[1]["near_edited"] == 1.0 and by[2]["near_next"] == 1.0  # 2 is followed by 1: two empty texts
    # the order within one id is a chain through all of its texts
    nexts = [r["edited"] for r in got if r["doc_id"] == 3]
    assert len(nexts) == 50
    assert compare_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fingerprint_column(spark):
    rows = [(1, "some words of a text", 5), (2, None, 6), (3, "some words of a text", 7)]
    df = spark.createDataFrame(rows, "id int, said string, `a.b` int").withColumn("fingerprint", F.lit("old"))
    got = fingerprints(df, "said").collect()
    assert [(r["id"], r["a.b"], r["fingerprint"]) for r in got] == [(i, b, plain_fingerprint(t or "")) for i, t, b in rows]
    pair = spark.createDataFrame([(got[0]["fingerprint"], got[2]["fingerprint"]), (got[0]["fingerprint"], got[1]["fingerprint"]), (None, "0" * 16)], "a string, b string")
    assert [r[0] for r in pair.select(alike("a", "b")).collect()] == [1.0, 0.0, None]


def test_slices(spark):
    """Rows in order, whatever the number of slices, one id with most rows included."""
    rows = [(i % 5 if i % 3 else 77, f"t{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = phrases.beside_next(spark, df).withColumn("p", F.spark_partition_id()).collect()
    own = [(r["id"], r["text"]) for r in ordered if not r["guard"]]
    assert sorted(own) == sorted(rows) and [i for i, _ in own] == sorted((i for i, _ in own), reverse=True)
    assert len({r["p"] for r in ordered if r["id"] == 77}) > 1
    runs = [[r for r in ordered if r["p"] == p] for p in sorted({r["p"] for r in ordered})]
    for run, after in zip(runs, [*runs[1:], runs[0]]):
        assert run[-1]["guard"] == 1 and run[-1]["text"] == after[0]["text"]


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_phrase_fingerprints"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids = sorted(got, reverse=True)
    text = {r["doc_id"]: r["text"] or "" for r in docs}
    assert len(got) == len(docs)
    for k, i in enumerate(ids):
        r, o = got[i], text[ids[(k + 1) % len(ids)]]
        assert r["n_chars"] == len(text[i]) and r["edited_sha256"] == hashlib.sha256(edited(text[i], o).encode()).hexdigest()
        if len(text[i]) < 2000:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_fingerprint(text[i]), plain_fingerprint(edited(text[i], o)))
    assert len({r["fingerprint"] for r in got.values()}) == len(set(text.values()))
    different = [r for k, (i, r) in enumerate(sorted(got.items(), reverse=True)) if r["n_chars"] >= 60]
    assert median(r["near_edited"] for r in different) > 0.55 and median(r["near_next"] for r in different) < 0.2
