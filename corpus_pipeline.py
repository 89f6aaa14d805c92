"""A training corpus from ``documents``: clean, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four
return the columns of ``documents``; the last returns doc_id, n_tokens and ids, a row for each document
as often as the mix takes it.
"""

from __future__ import annotations

from dataclasses import replace

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import language, line_templates, minhash, mixing, prefix_bpe
from logloom.llm.common import prepare, stored, table

NEAR = minhash.Options(shingle_words=5, percent=80)
LINES = line_templates.Options(levels=True, long_tokens=50)
ORACLE_SQL = None  # the first stage learns a model; tests compare the stages with brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no learned language or in an ambiguous one, null ones and those without a letter."""
    prepare(spark)
    return language.understood(docs, language.train(docs, limits=True))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates, and long lines that recur at all, from all documents but the first; documents stay.

    Near copies count as one document and keep or lose the same lines, so the next stage finds them as they are.
    Null, empty and repeated texts pass; columns of any name pass, n_chars (if there is one) is counted anew.
    """
    prepare(spark)
    classes = minhash.near_duplicates(docs.select("doc_id", "text"), replace(NEAR, native=True))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), "doc_id", "text")
    rest = line_templates.without_recurring_lines(own, LINES, classes)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("text").isNotNull(), counted).otherwise(F.col("document.n_chars"))
    return rest.select(*(new.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id."""
    prepare(spark)
    return minhash.one_of_each(docs, NEAR)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; null and empty texts have no words and are never taken, a null source is one."""
    prepare(spark)
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row; a null or empty text has none, repeated rows are encoded alike."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
