"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, sources are mixed
to target weights, and texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one ids as well. Null texts pass as
texts without words, an empty table stays empty. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.llm import bpe, jaccard, mixing, substring, toxicity
from parchment.llm.common import apart, forget, quoted, scratch, stored, table

#: A document goes from this score on.
TOXIC = 0.3
RANKS = "byte_bpe_50k.tiktoken"


def hidden(docs: DataFrame, outputs: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs whose columns of an output's name stand under another one, and what gives docs' columns back from a result."""
    own = apart(docs)[1]
    names = {c: own(c) for c in docs.columns if c.lower() in outputs}
    return docs.withColumnsRenamed(names), lambda done: done.select(*[quoted(names.get(c, c)).alias(c) for c in docs.columns])


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the model, fitted on the labelled ones among them, finds toxic; all of them if no model could be fitted."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    rows, back = hidden(docs, ("score", "toxic_spans"))
    return back(toxicity.score(rows, model).where(F.col("score") < TOXIC))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies: near by SimHash of 5-word shingles, then of similarity 0.8 or more.
    Of rows of one id the one whose columns have the least hash stays; rows without an id all stay."""
    own = apart(docs)[1]
    # tables of known size, so that Spark sends them to all tasks if they are small, and texts stay where they are
    gone = jaccard.copies(docs).select(F.col("node").alias(own("id")))
    several = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NOT NULL AND n > 1").select(F.col("doc_id").alias(own("id"))), "several")
    same = F.col("doc_id") == F.col(own("id"))
    kept = docs.join(gone, same, "left_anti")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64(*map(quoted, docs.columns))))
    first = kept.join(several, same, "left_semi").withColumn(own("nth"), place).where(F.col(own("nth")) == 1).drop(own("nth"))
    return kept.join(several, same, "left_anti").unionByName(first)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words of passages that start earlier in the corpus; a document that has no word left goes."""
    rows, back = hidden(docs, ("n_words", "n_removed", "removed", "kept_text"))
    done = substring.dedup(rows)
    cut = F.col("n_removed") > 0
    done = done.where(~cut | (F.col("n_removed") < F.col("n_words")))
    done = done.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    return back(done.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut gives its first words."""
    rows, back = hidden(docs, mixing.OUTPUTS)
    done = mixing.repeat(mixing.mix(rows), rows.columns)
    return back(done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With n_tokens, ids (little-endian unsigned 32-bit integers), and whether decoding gives the text back; columns of these
    names are replaced."""
    own = apart(docs)[1]
    keep = apart(docs, ("n_tokens", "ids", "decodes"))[0]
    done = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=own("ids"), decoded=own("decoded"))
    same = F.col(own("decoded")) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select(*keep, (F.octet_length(own("ids")) / 4).cast("long").alias("n_tokens"), F.col(own("ids")).alias("ids"), same.alias("decodes"))


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("mixing", mixed_sources),
    ("byte_bpe", encoded),
]

#: SQL can express neither the fitted model nor the fingerprints; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each one's rows are written to the shared folder; then what it stored for itself goes, and the rows of the
    stage before. The last stage's input stays, as it is read when the result is."""
    docs = table(spark, sf_dir, "documents")
    for nth, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():
            made = stored(stage(spark, docs, sf_dir), name, keep=True)
        if nth:
            forget(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
