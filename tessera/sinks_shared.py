"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """An unused path below spark.checkpoint.dir; below a temporary folder only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tessera_scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark._tessera_scratch = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them again. Lost executors then cost one stage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
