"""Landed text with many records per file, in a total order.

A record ends with a separator (a blank line, say), so files are split and read
by many tasks like any text. Records are ordered by (file time, file path,
place in the file): the place is the start of the split and the record's place
in it. ``seq`` is the position in that order, from 0, computed by the chunked
scan, so no task sees all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.scan import row_index
from rollcall.session import cut_lineage

_ORDER = ["_ts", "_path", "_block", "_place"]


def read_records(spark: SparkSession, path: str, separator: str,
                 columns: list[str] | None = None) -> DataFrame:
    """(seq, ts, value, *columns) of every record; ``columns`` are folder
    columns (``name=value``). Empty records are dropped."""
    raw = spark.read.option("lineSep", separator).text(path)
    meta = "_metadata.file_"
    placed = raw.select(
        F.col(meta + "modification_time").alias("_ts"), F.col(meta + "path").alias("_path"),
        F.col(meta + "block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"),
        "value", *(columns or []), F.lit(0).alias("_all")).where(F.trim("value") != "")
    # written once: the place within a split must be the same wherever it is read
    placed = cut_lineage(placed)
    return (row_index(placed, ["_all"], _ORDER, "seq", split=True)
            .select("seq", F.col("_ts").alias("ts"), "value", *(columns or [])))
