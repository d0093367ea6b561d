"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmart.llm import (
    conversations, decontaminate, disclosure, packing, pages, passages, quality, secret_scan, sentencepiece, simhash, spellings, suffixes,
    tools,
)
from spanmart.llm.common import load


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = Query(fn, sql)
        return fn

    return add


def piece_model() -> str:
    """The public 32k merge-type model; its place is given by the installed vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_decode(load(spark, sf_dir, "documents"), piece_model())


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_bits",
    )


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(load(spark, sf_dir, "documents"))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(load(spark, sf_dir, "pages"))


@query()
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(load(spark, sf_dir, "documents"))


@query()
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.linked(tools.as_messages(load(spark, sf_dir, "conversations")), tools.DERIVED)


@query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(load(spark, sf_dir, "documents"))


@query()
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(load(spark, sf_dir, "documents"))


@query()
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"), word_tokenizer()).withColumn(
        "length", F.col("length").cast("long")
    )


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(load(spark, sf_dir, "documents"))


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(load(spark, sf_dir, "conversations"))
