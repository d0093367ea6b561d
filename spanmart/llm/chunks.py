"""Distinct texts in chunks, and packed arrays passed between chunks and buckets.

Operators that compare all passages of all texts work in rounds: every chunk of texts sends
packed arrays to buckets of a hash, every bucket sends its findings back to the chunks they
came from.  Spark shuffles a few binary rows per pair of chunk and bucket; inside tasks numpy
works on them.  Chunks and buckets follow the session's shuffle partitions, so both stay of the size that
a task is meant to hold; small tables have no more of them than their bytes need, as the messages are up to
chunks times buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import NO_ID, binaries, documents, partitions, with_library

CHUNKS = 3
# Bytes that fill a chunk, and chunks that are worth having for fewer.
CHUNK_BYTES = 8 << 20
FEW_CHUNKS = 24
PACKED = "bucket int, chunk int, data binary"
# Rows of one group of copies, of which the smallest id stands for all.
TEXTS = "chunk int, doc_id long, text string"


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id (missing: after all others) and text of every row."""
    return documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def chunk_count(docs: DataFrame) -> int:
    """Chunks for these texts, which one narrow job measures; at most ``CHUNKS`` for each shuffle partition."""
    size = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
    needed = max(FEW_CHUNKS, math.ceil(size / CHUNK_BYTES))
    return min(CHUNKS * partitions(docs.sparkSession), needed)


def bucket_count(chunks: int) -> int:
    return -(-chunks // CHUNKS)


def distinct_texts(docs: DataFrame, n: int) -> DataFrame:
    """The distinct texts with their smallest doc_ids, dealt evenly into ``n`` chunks and shuffled once.

    Copies are combined in each part of the table before the shuffle; a text that several parts hold comes
    several times, all in one chunk, where ``once`` tells the smallest doc_id.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            keep = []
            for i, (doc, text) in enumerate(zip(batch["doc_id"].to_pylist(), binaries(batch["text"]), strict=True)):
                digest = hashlib.sha256(text).digest()
                if doc < known.get(digest, NO_ID + 1):
                    known[digest] = doc
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    one = with_library(docs.select("doc_id", "text")).mapInArrow(least, "doc_id long, text string")
    return one.select(F.pmod(F.xxhash64("text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text").repartition("chunk")


def dealt_rows(docs: DataFrame, n: int) -> DataFrame:
    """All rows, copies too, dealt evenly into ``n`` chunks by id and text, so that the texts are shuffled once only."""
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(chunk.alias("chunk"), "doc_id", "text")


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def per_chunk(texts: DataFrame, found: DataFrame | None, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn(chunk, ids, texts, messages)`` to every chunk of texts and what came back for it.

    ``messages`` are (bucket, data) pairs.  ``fn`` yields dictionaries of columns.
    """
    arrow = arrow_schema(schema)

    def read(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
        # A fixed order, so that places in a chunk mean the same in every round.
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return table["doc_id"].to_numpy(), table["text"].cast(pa.large_binary()).to_pylist()

    def pack(out: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for columns in out:
            yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    def alone(key, table):
        ids, bodies = read(table)
        return pa.Table.from_batches(list(pack(fn(key[0].as_py(), ids, bodies, []))), schema=arrow)

    if found is None:
        return with_library(texts).groupBy("chunk").applyInArrow(alone, schema)

    def both(key, left, right):
        if not left.num_rows:
            return arrow.empty_table()
        ids, bodies = read(left)
        messages = list(zip(right["bucket"].to_pylist(), right["data"].to_pylist(), strict=True))
        made = list(pack(fn(key[0].as_py(), ids, bodies, messages)))
        return pa.Table.from_batches(made, schema=arrow)

    return with_library(texts).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(both, schema)


def per_bucket(sent: DataFrame, fn: Callable, schema: str = PACKED) -> DataFrame:
    """Apply ``fn(bucket, messages)`` to every bucket; ``messages`` are (chunk, data) pairs."""
    arrow = arrow_schema(schema)

    def run(key, table):
        messages = list(zip(table["chunk"].to_pylist(), table["data"].to_pylist(), strict=True))
        messages.sort(key=lambda m: (m[0], len(m[1])))
        made = [pa.RecordBatch.from_pydict(c, schema=arrow) for c in fn(key[0].as_py(), messages)]
        return pa.Table.from_batches(made, schema=arrow)

    return with_library(sent).groupBy("bucket").applyInArrow(run, schema)


def by_chunk(fn: Callable, schema: str) -> Callable:
    """``fn(chunk, table)`` for the rows of every chunk, to apply to groups; it yields dictionaries of columns."""
    arrow = arrow_schema(schema)

    def run(key, table):
        made = [pa.RecordBatch.from_pydict(c, schema=arrow) for c in fn(key[0].as_py(), table)]
        return pa.Table.from_batches(made, schema=arrow)

    return run


def by_bucket(values: np.ndarray, n: int) -> np.ndarray:
    """Bucket of unsigned 64-bit hashes, by ranges of equal width."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones and so on: those of small or sorted numbers compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def squeezed(*parts: bytes) -> bytes:
    """Parts of a message, compressed each: shuffles squeeze columns of many rows less, and small blocks worse."""
    small = [pa.compress(p, codec="zstd", asbytes=True) for p in parts]
    sizes = np.array([(len(p), len(s)) for p, s in zip(parts, small, strict=True)], "<i8")
    return bytes([len(parts)]) + sizes.tobytes() + b"".join(small)


def unsqueezed(data: bytes) -> list[bytes]:
    sizes = np.frombuffer(data, "<i8", 2 * data[0], 1).reshape(-1, 2).tolist()
    out, at = [], 1 + 16 * data[0]
    for size, small in sizes:
        out.append(pa.decompress(data[at : at + small], size, codec="zstd", asbytes=True))
        at += small
    return out


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return start, np.r_[start[1:], len(sorted_values)]
