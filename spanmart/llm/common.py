"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmart.sources.readers import read_table

# Rows without an id count as later than every row that has one.
NO_ID = (1 << 63) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names; a missing text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col].cast("string")).alias("text")
    )


def binaries(column) -> list[bytes]:
    """A string column of a batch as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def with_library(df: DataFrame) -> DataFrame:
    """Let Python workers find this library where the driver found it (a cluster gets it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_rows(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns columns by name, or None for no rows."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return with_library(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``size`` bytes, one row at least, so that memory follows no batch's width."""
    n = batch.num_rows
    step = max(1, min(n, int(n * size / max(batch.nbytes, 1)))) if n else 1
    for at in range(0, n, step):
        yield batch.slice(at, step)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; whoever sizes the job sizes them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        # Unset, as in tests: a session on one machine.
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = context.getCheckpointDir() or tempfile.mkdtemp(prefix="spanmart-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: their size is then known, so a small side is broadcast."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
