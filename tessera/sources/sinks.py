"""Writers that keep a table by key, part uploads, and result files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ingest import upsert


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table kept by ``write_upsert``; none if it was never written."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    newest = versions.agg(F.max("version")).head()[0]
    return versions.where(F.col("version") == newest).drop("version")


def write_upsert(new: DataFrame, path: str, keys: list[str]) -> int:
    """Merges rows by key into a table of files and gives its new version's number.

    A version is a partition that appears whole or not at all; readers use the newest, so a job that is run again changes nothing.
    """
    spark = new.sparkSession
    old = read_version(spark, path)
    rows = new if old is None else upsert(old, new.select(old.columns), keys)
    version = 1 if old is None else spark.read.parquet(path).agg(F.max("version")).head()[0] + 1
    rows.write.parquet(f"{path}/version={version}")
    return version


def merge_parts(spark: SparkSession, folder: str) -> DataFrame:
    """name and content of uploads that came as files <name>_part_<n>: parts 1..N in order. An upload that lacks a part is left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*_part_*").load(folder)
    part = lambda k: F.regexp_extract("path", r"([^/]+)_part_(\d+)$", k)
    parts = rows.select(part(1).alias("name"), part(2).cast("int").alias("n"), "content")
    of = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("o"), F.max("n").alias("last"))
    whole = of.where(F.size("o") == F.col("last"))
    return whole.select("name", F.aggregate("o", F.lit(b""), lambda a, x: F.concat(a, x.content)).alias("content"))


def write_results(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A result as csv (with header) or json lines."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def read_results(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A result that ``write_results`` wrote."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Further rows of a result of json lines; those that are there stay as they are."""
    rows.write.mode("append").json(path)


def set_aside(rows: DataFrame, failed, path: str) -> DataFrame:
    """Rows that did not fail; those that did are written to a folder of their own for later."""
    rows.where(failed).write.mode("append").parquet(path)
    return rows.where(~failed)
