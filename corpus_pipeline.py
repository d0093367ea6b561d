"""From raw documents to encoded training data, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanmart.llm import decontaminate, quality, secret_scan, sentencepiece, simhash
from spanmart.llm.common import load, shared_folder
from spanmart.llm.queries import Query, piece_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality.rejected_removed(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints of three-word shingles at most 2 bits apart."""
    return simhash.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those that are mostly such passages go."""
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secret_scan.masked(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and their digests."""
    return sentencepiece.encode_decode(docs, piece_model(), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("benchmark passages", benchmark_passages),
    ("secret values", secret_values),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written to the shared folder and read again for the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Fingerprints, the automaton, the forest and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
