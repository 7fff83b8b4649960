"""Small helpers the operators share: row keys, scratch tables, batches."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rollcall.session import scratch_path


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of a row: equal only for rows equal in id and text (a null
    in either is a value of its own), so rows without an id have one too."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")),
                      F.lit("\x01"), F.col(text_col).isNull(), F.col(text_col))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, read back: read
    more than once without being computed again, and its size is known to the
    planner. The folder is the session's checkpoint folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema_with(df: DataFrame, *fields: StructField) -> StructType:
    """The fields of ``df`` and then ``fields``; a column of ``df`` with the
    name of a new field gives way to it."""
    names = {f.name for f in fields}
    return StructType([f for f in df.schema.fields if f.name not in names] + list(fields))


#: rows, and bytes where the Spark version knows the setting, of one Arrow
#: batch: a task holds a few megabytes of texts at a time
BATCH_ROWS, BATCH_BYTES = 500, "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for this session, unless it sets its own: whole
    texts are long, and the default is counted in rows alone."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path under the shared folder, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return pafs.LocalFileSystem(), uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)
