"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: spark.checkpoint.dir, or what the application has set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, and the number of rows, counted while they are written."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return done, seen.get["n"]


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a table beside the checkpoints, which takes less disk than a checkpoint of many rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """What is planned meanwhile shuffles into n partitions, as planned: a long plan isn't optimised anew after each of its stages."""
    wanted = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
