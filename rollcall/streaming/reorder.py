"""A reorder buffer in front of a job that needs events in order.

The buffer holds the rows of the last ``delay`` of event time. With each
micro-batch the watermark, the latest event time seen less the delay, moves up;
rows before it are released, together, and those that come later with a time
before what was released already are late: they go to a side output, one folder
per micro-batch, and are never lost. So rows that arrive out of order within the
delay reach the job in order across micro-batches, whatever files or partitions they
came in.

Rows are kept as tables in the state folder: a batch writes the rows it holds
back, which the delay bounds, not the log. A replayed batch reads the buffer of
the batch before and releases the same rows. Rows still held at the end of a log
are ``held``: a job can be asked for its result as if they were released.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rollcall.session import child_names, cut_lineage
from rollcall.streaming.snapshots import batch_ids, read_snapshot, snapshot_folder, write_snapshot

#: microseconds since 1970, which no time zone bears on
_MARKS = StructType([StructField("latest", LongType()), StructField("released", LongType())])


class ReorderBuffer:
    """A buffer by the timestamp column ``time``, kept under ``path``."""

    def __init__(self, spark: SparkSession, path: str, time: str = "ts"):
        self.spark, self.time = spark, time
        self._rows, self._marks, self._late = (os.path.join(path, n) for n in ("held", "marks", "late"))

    def release(self, batch: DataFrame, batch_id: int, delay: str) -> DataFrame:
        """The rows that may go on, now that ``batch`` has come; ``delay`` is an
        interval (``"10 minutes"``). Rows without a time wait for nothing."""
        marks = read_snapshot(self.spark, self._marks, _MARKS, before=batch_id).first()
        latest, released = (marks.latest, marks.released) if marks else (None, None)
        batch = cut_lineage(batch)
        when = F.unix_micros(F.col(self.time).cast("timestamp"))
        if released is not None:
            late = batch.where(when < released)
            if not late.isEmpty():
                late.write.mode("overwrite").parquet(os.path.join(self._late, f"batch_id={batch_id}"))
            batch = batch.where(when.isNull() | (when >= released))
        top = batch.agg(F.max(when)).first()[0]
        latest = max((t for t in (latest, top) if t is not None), default=None)
        if latest is not None:
            mark = self.spark.range(1).select(F.unix_micros(
                F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {delay}"))).first()[0]
            released = mark if released is None else max(mark, released)
        here = cut_lineage(read_snapshot(self.spark, self._rows, batch.schema, before=batch_id)
                           .unionByName(batch))
        go = when.isNull() if released is None else when.isNull() | (when < released)
        write_snapshot(here.where(~go), self._rows, batch_id)
        write_snapshot(self.spark.createDataFrame([(latest, released)], _MARKS), self._marks, batch_id)
        return here.where(go)

    def held(self) -> DataFrame | None:
        """Rows that wait for the watermark; None before the first batch."""
        ids = batch_ids(self.spark, self._rows)
        return self.spark.read.parquet(snapshot_folder(self._rows, ids[-1])) if ids else None

    def late(self) -> DataFrame | None:
        """Rows that came after their time had been released, with the
        ``batch_id`` they came in; None where there are none."""
        if not child_names(self.spark, self._late):
            return None
        return self.spark.read.parquet(self._late)
