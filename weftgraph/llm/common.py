"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """True for the rows a fit never sees. A null id is not held out (and never labelled)."""
    return F.coalesce(crc_bucket(doc_id, n) == F.lit(remainder), F.lit(False))


def carried(docs: DataFrame, names: list[str] | None) -> list[Column]:
    """The columns an operator hands through unread, as one struct named row, so that no name can clash."""
    return [F.struct(*(docs[c] for c in names)).alias("row")] if names else []


def carried_kind(df: DataFrame) -> str:
    """Schema text for the struct of carried columns, if there is one."""
    return f", row {df.schema['row'].dataType.simpleString()}" if "row" in df.columns else ""


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table again, from its text and the struct of all others."""
    return df.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns))


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice hold about max_bytes; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // max_bytes
    start = 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, which all executors share: spark.checkpoint.dir, or what it has set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the checkpoint folder; smaller than a checkpoint, for wide tables."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
