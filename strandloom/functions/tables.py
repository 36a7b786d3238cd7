"""Intermediate tables of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a local master, as in tests, one of our own stands in where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = getattr(spark.sparkContext, "_strandloom_dir", None)
    if known is None:
        known = spark.sparkContext._strandloom_dir = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return known


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, its size known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
