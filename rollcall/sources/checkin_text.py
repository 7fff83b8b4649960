"""Check-ins landed as text: the listener's output, one file per connection.

A listener run prints a banner line, the ``connect to [...] from (...) [...]
port`` line and then the caller's request line. Each landed file is one run
(one check-in). The file is read whole (``wholetext``); the connect line and
the first HTTP request line are taken from it by pattern, so a banner or a
missing line does not shift them. ``ts`` is the file's modification time and
``seq`` that time in microseconds, the order in which check-ins landed;
files landing in the same microsecond count as simultaneous.

Output: (seq, ts, connect_line, request_line), the input of
``parse_checkins``; either line is '' when the file has none (a malformed
check-in, set aside by the jobs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.landed import read_records
from rollcall.sources.record_stream import record_stream

# The shape of the two lines a listener run prints.
CONNECT_LINE = r"(?m)^(connect to .*?)\r?$"
REQUEST_LINE = r"(?m)^(\S+ \S+ HTTP/\d\.\d)\r?$"


def _lines() -> list[Column]:
    return [F.regexp_extract("value", CONNECT_LINE, 1).alias("connect_line"),
            F.regexp_extract("value", REQUEST_LINE, 1).alias("request_line")]


def _shape(raw: DataFrame) -> DataFrame:
    ts = F.col("_metadata.file_modification_time")
    return raw.select(F.unix_micros(ts).alias("seq"), ts.alias("ts"), *_lines())


def read_checkin_texts(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Landed listener files -> check-in rows (batch): one run per file, or
    with ``separator`` many runs per file in a total order
    (``sources.landed``)."""
    if separator is not None:
        return read_records(spark, path, separator).select("seq", "ts", *_lines())
    return _shape(spark.read.text(path, wholetext=True))


def checkin_text_stream(spark: SparkSession, path: str,
                        max_files_per_trigger: int | None = None, separator: str | None = None,
                        max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Landed listener files -> check-in rows, as they land (stream): one run
    per file, or with ``separator`` many (``sources.record_stream``)."""
    if separator is not None:
        records = record_stream(spark, path, separator, max_bytes_per_trigger=max_bytes_per_trigger)
        return records.select("seq", "ts", *_lines())
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _shape(reader.text(path, wholetext=True))
