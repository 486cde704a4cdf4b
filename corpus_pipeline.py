"""A corpus pipeline of five stages over documents; each stage's Parquet output is the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, language_id, mixing, ngram_join, secrets
from weftgraph.session import delete, materialize, scratch, shared_dir, table

#: A document must reach this cosine with some language: three standard deviations of the cosine of unlike profiles.
LEAST_SCORE = 3 / language_id.DIMS**0.5


def _aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns renamed whose names an operator uses for its own, and what brings the names and columns of docs back."""
    names = {c: c if c.lower() not in used else f"{c}_{uuid.uuid4().hex}" for c in docs.columns}
    return docs.withColumnsRenamed(names), lambda df: df.select(*[F.col(f"`{new}`").alias(c) for c, new in names.items()])


def _whole(docs: DataFrame) -> DataFrame:
    """docs as one column, row, whose fields clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them), and those like no language; puts the predicted language where lang is null.

    A null id takes part in training. Repeated rows are judged alike. No rows, no result; without a labelled text all go.
    """
    d, back = _aside(docs, ("held_out", "lang_pred", "score"))
    made = language_id.identify(d).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return back(made.withColumn("lang", F.coalesce("lang", "lang_pred")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five words, 0.8).

    Rows with a null id stay, as do null and empty texts and all rows that share the kept id. No rows, no result.
    """
    joined = ngram_join.join(docs.select("doc_id", "text"), 5, Fraction(4, 5))
    gone = materialize(joined.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return _whole(docs).join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with [SECRET] in place of each secret. Null and empty texts stay as they are, repeated rows change alike. No rows, no result."""
    d, back = _aside(docs, ("n_candidates", "secrets", "redacted"))
    made = secrets.scan(d)
    return back(made.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("redacted").cast("long")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number; none if it takes fewer than half.

    Null, empty and wordless texts go, as the mix takes no words of them. A null source is a source of its own. Rows that
    share an id, a null one too, are taken equally often. No rows, no result.
    """
    taken = mixing.mix(docs.select("doc_id", "source", "text")).where("size > 0")
    times = taken.groupBy(F.col("doc_id").alias("id")).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("times")).where("times > 0")
    repeated = _whole(docs).where(mixing.word_count(F.col("row.text")) > 0).join(times, F.col("row.doc_id").eqNullSafe(F.col("id")))
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token ids, their number, and a digest of what they decode to.

    A null text counts as empty and has no tokens. Every row is encoded by itself. Further columns go. No rows, no result.
    """
    docs = docs.select("doc_id", "lang", "source", "text")
    made = byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)
    return made.select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256")


STAGES = [("language", language_stage), ("ngram_join", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("byte_bpe", tokens_stage)]

#: The stages hold a trained model, a near-duplicate join and a tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage leaves in the shared folder goes when the next one's input is written."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if before:
            delete(spark, before)
        before = f"{at}/{name}"
        docs = spark.read.parquet(before)
    return docs
