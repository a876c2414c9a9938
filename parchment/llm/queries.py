"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import bpe, chat, mixing, periodic, phrases, quality_model, quality_rules, sharding, simhash, substring, topk, toxicity, whitening
from parchment.llm.common import table, words
from parchment.llm.labelled import held_out
from parchment.llm.oracles import SQL  # noqa: F401

RANKS = "byte_bpe_50k.tiktoken"
#: op5's bytes in a shard.
SHARD_BYTES = 256 << 10


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = f"{chat.END}{chat.START}assistant ok"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(trap).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    events = logs.unionByName(own).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("event"), F.col("turn").alias("message_id"), "role", "text")
    rendered = chat.render(chat.fold(events))
    back = rendered.select(
        "conv_id",
        "block",
        "n_turns",
        F.length("formatted").cast("long").alias("n_chars"),
        F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_mask")), "").alias("learned"),
    )
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", c))), lambda x: x[c]), "")
    whole = back.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), joined("said").alias("said"), joined("learned").alias("learned"), F.sum("n_chars").alias("formatted_chars"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_BYTES)
    return done.select("doc_id", "doc_bytes", "shard", "depth", "shard_bytes", "oversize")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=4, remainder=2)
    done = toxicity.score(docs, model)
    toxic = (F.col("score") >= 0.3) & F.lit(model.fitted)  # without a model the score is the same for all
    return done.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", toxic.cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), modulus=5, remainder=0)
    done = quality_model.score(docs, model)
    return done.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return done.select("query_id", "rank", "vec_id", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op12_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrases.compare_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def with_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, whose words from a place on repeat with a period in a tenth of the documents, as op13's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.floor(h / 10).cast("long"), words(F.col("text"))
    n = F.nullif(F.size(w).cast("long"), F.lit(0).cast("long"))
    made = docs.select("doc_id", "text", w.alias("w"), n.alias("n"), (h % 10 == 0).alias("_chosen"), g.alias("g"), (g % n).alias("a"))
    made = made.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at, p, rest = F.col("a").cast("int"), F.col("p").cast("int"), (F.col("n") - F.col("a")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", at + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    text = F.when(F.col("_chosen") & F.col("n").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), at), again), " ")).otherwise(F.col("text"))
    return made.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic.find(with_period(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_chat_formatting, op4_substring_dedup, op5_sharding, op6_simhash, op7_mixing, op8_toxicity, op9_quality_model, op10_topk, op11_whitening, op12_phrase_fingerprints, op13_periodic_runs)}
