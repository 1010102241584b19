"""Cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame


def _folder(context: SparkContext) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or in local mode one of our own where the session has none."""
    if not context.getCheckpointDir():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="rallyframe-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, written to the checkpoint folder, so that reading them twice gives the same rows in the same partitions."""
    _folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows of df, written as Parquet to the checkpoint folder: each later reader takes the columns it asks for, and of the columns `by` the values."""
    path = f"{_folder(df.sparkSession.sparkContext).rstrip('/')}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
