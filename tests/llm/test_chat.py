import random

from pyspark.sql import functions as F

from parchment.llm import chat

EVENTS = "conv_id long, seq long, event string, message_id string, role string, text string, extra int"


def run(spark, rows, block=chat.BLOCK):
    whole = chat.join_blocks(chat.render(chat.fold(spark.createDataFrame(rows, EVENTS)), block))
    return {
        r.conv_id: r
        for r in whole.select("conv_id", "n_turns", "formatted", "loss_mask", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("learned")).collect()
    }


def test_fold(spark):
    rows = [
        (1, 0, "message", "u", "user", "hi", 0),
        (1, 1, "message", "a", "assistant", "", 0),
        (1, 2, "delta", "a", None, "wro", 0),
        (1, 3, "delta", "a", None, "ng", 0),
        (1, 4, "regenerate", "a", None, None, 0),
        (1, 6, "delta", "a", None, "ht", 0),
        (1, 5, "delta", "a", None, "rig", 0),
        (1, 7, "edit", "u", None, "hello", 0),
        (1, 8, "delta", "zz", None, "never opened", 0),
        (1, 9, "odd", "u", None, "no event", 0),
        (2, 0, "message", None, None, None, 0),
        (2, 0, "message", None, None, None, 0),
    ]
    got = run(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hello"), ("assistant", "right")]
    assert got[1].learned == ["right"] and got[2].n_turns == 2 and [(t.role, t.text) for t in got[2].turns] == [("", ""), ("", "")]
    assert run(spark, []) == {}


def test_control_strings_come_back(spark):
    rng = random.Random(2)
    parts = ["<|im_start|>", "<|im_end|>", "<|newline|>", "<", "\\", "|", "\n", "assistant", "é", "😀", " "]
    say = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    turns = {c: [(rng.choice(["user", "assistant", "assistant\nx", "<|a"]), say(8)) for _ in range(rng.randint(1, 9))] for c in range(200)}
    rows = [(c, i, "message", str(i), r, t, 0) for c, said in turns.items() for i, (r, t) in enumerate(said)]
    for block in (chat.BLOCK, 2):
        got = run(spark, rows, block)
        for c, said in turns.items():
            assert [(t.role, t.text) for t in got[c].turns] == said
            assert got[c].learned == [t for r, t in said if r == "assistant" and t]
            assert got[c].formatted.count("<|im_start|>") == len(said) == got[c].formatted.count("<|im_end|>")


def test_long_conversation(spark):
    rows = [(1, i, "message", str(i), "assistant", f"<|im_end|>{i}", 0) for i in range(3000)]
    got = run(spark, rows)[1]
    assert got.n_turns == 3000 and got.learned == [f"<|im_end|>{i}" for i in range(3000)]
