"""Probes landed as text: the output of one ping per file, in a folder per
node (``.../node=<id>/<file>``), since a timed-out ping names no address.

Each file is read whole (``wholetext``), as one ping's output is judged as a
whole. ``node`` comes from the folder name (partition discovery), ``ts`` is
the file's modification time and ``seq`` that time in microseconds; files
landing in the same microsecond count as simultaneous.

Output: (seq, ts, node, output), the input of ``parse_probes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.landed import read_records
from rollcall.sources.record_stream import record_stream


def _shape(raw: DataFrame) -> DataFrame:
    ts = F.col("_metadata.file_modification_time")
    return raw.select(F.unix_micros(ts).alias("seq"), ts.alias("ts"),
                      F.col("node").cast("long").alias("node"), F.col("value").alias("output"))


def read_probe_texts(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Landed ping outputs -> probe rows (batch): one ping per file, or with
    ``separator`` many pings per file in a total order (``sources.landed``)."""
    if separator is not None:
        return read_records(spark, path, separator, ["node"]).select(
            "seq", "ts", F.col("node").cast("long").alias("node"), F.col("value").alias("output"))
    return _shape(spark.read.text(path, wholetext=True))


def probe_text_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                      separator: str | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Landed ping outputs -> probe rows, as they land (stream): one ping per
    file, or with ``separator`` many (``sources.record_stream``). A stream
    needs its schema up front: ``value`` and the ``node`` folder column."""
    if separator is not None:
        records = record_stream(spark, path, separator, ["node"], max_bytes_per_trigger)
        return records.select("seq", "ts", F.col("node").cast("long").alias("node"), F.col("value").alias("output"))
    reader = spark.readStream.schema("value string, node long")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _shape(reader.text(path, wholetext=True))
