"""Reading the driver's Parquet tables, with only the needed columns so that
the scan's ReadSchema is pruned."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet folder at ``path``, or an empty frame of ``schema`` when
    nothing has been written there yet."""
    from pyspark.errors import AnalysisException

    try:  # ask the file system first (any Hadoop scheme), to skip a failed read
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
            return spark.createDataFrame([], schema)
    except Exception:  # no JVM access (e.g. Spark Connect): just try the read
        pass
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return spark.createDataFrame([], schema)
        raise
