"""The numbered queries over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import (
    fill_in_middle,
    language,
    line_templates,
    minhash,
    mixing,
    neighbours,
    oracle,
    phrases,
    pii,
    prefix_bpe,
    syncmers,
    token_files,
    url_filter,
    warc,
)
from logloom.llm.common import table
from logloom.llm.url_filter import Rule
from logloom.session import scratch_path

LINES = line_templates.Options(levels=True, long_tokens=50)
URL_RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
    Rule("example.org", "/en/1", "block"),
)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.without_recurring_lines(docs, LINES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(language.learnable(F.col("doc_id"))))
    held_out = (~language.learnable(F.col("doc_id"))).alias("held_out")
    return language.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by(URL_RULES, pages))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"), density=1)


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, minhash.Options(shingle_words=2)).drop("text_key")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = warc.archived(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return rows.drop("url", "payload")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", restored))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = pii.personal_data(docs, pii.train(docs))
    counts = [column.alias(f"n_{kind}") for kind, column in pii.counts(F.col("base")).items()]
    digest = F.sha2(pii.written_out(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, pii.written_out(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.SQL.items() if name in queries()}
