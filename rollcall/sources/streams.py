"""Streaming sources: landed Parquet files read as a stream.

A file stream source needs a folder; a single table file is picked out of its
folder with ``pathGlobFilter``. The schema is taken from the files' footers
(no inference at stream time).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rollcall.sources.tables import table_path


def parquet_stream(spark: SparkSession, folder: str, file_glob: str = "*.parquet",
                   schema=None, max_files_per_trigger: int | None = None) -> DataFrame:
    if schema is None:
        schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder)


def _is_dir(spark: SparkSession, path: str) -> bool:
    try:  # any Hadoop file system
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.getFileStatus(hpath).isDirectory())
    except Exception:
        return os.path.isdir(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, **kw) -> DataFrame:
    """The table ``name`` of ``sf_dir`` as a stream: its folder of part files,
    or the single table file picked out of ``sf_dir``."""
    path = table_path(sf_dir, name)
    if _is_dir(spark, path):
        return parquet_stream(spark, path, "*.parquet", **kw)
    return parquet_stream(spark, os.path.dirname(path), os.path.basename(path), **kw)
