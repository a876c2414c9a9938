"""Spans around markers against a plain version; they are made in the text's row."""

import random

from parchment.operators import budget


def plain(text, markers, before, after, most):
    at = []
    for m in markers:
        i = text.find(m)
        while i >= 0:
            at.append(i)
            i = text.find(m, i + len(m))
    out = []
    for i in sorted(at[:most]):
        a, b = max(0, i - before), min(len(text), i + after)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] + 1)
        else:
            out.append((a, b, 1))
    return out


def test_spans(spark):
    rng, markers = random.Random(2), ["ab", "b", "é."]
    texts = ["".join(rng.choice("abcé.   \n") for _ in range(rng.randrange(300))) for _ in range(60)] + ["", "ab", "zz"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    for before, after, most in ((0, 3, 5), (2, 2, 400), (9, 1, 1)):
        got = sorted(tuple(r) for r in budget.marker_spans(df, markers=markers, before=before, after=after, most=most).collect())
        assert got == sorted((i, *s) for i, t in enumerate(texts) for s in plain(t, markers, before, after, most))


def test_no_text_leaves_its_row(spark, capsys):
    budget.focused(spark.createDataFrame([(1, "the ab")], "doc_id long, text string"), 2000, markers=["ab"]).explain()
    assert "Exchange" not in capsys.readouterr().out
