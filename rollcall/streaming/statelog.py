"""Keyed state of a foreachBatch stream as a log of segments.

A micro-batch writes the rows whose state it changed, and nothing else: one
segment, the batch's. Then the newest segments are merged as long as the older one
has less than twice the bytes of the newer: sizes more than double from a segment
to the one before it, so their number grows with the logarithm of the state, and a
row is rewritten only when the segment it lies in at least grows by half. What
batches write follows what they change, not the size of the state. The newest
segment that has a key holds its state.

A batch reads what was written before it. Segments it merges stay until the
next batch begins, which proves that this one was committed, so a replayed batch
finds the state it found the first time and writes the same segments again.
"""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollcall.session import child_names, drop_path, folder_bytes

_NAME = re.compile(r"batches-(\d+)-(\d+)$")
_AGE = "_statelog_age"

#: first batch, last batch
Segment = tuple[int, int]


class StateLog:
    """State of ``schema`` with one row per ``keys``, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def _folder(self, s: Segment) -> str:
        return os.path.join(self.path, "batches-{}-{}".format(*s))

    def segments(self) -> list[Segment]:
        """All complete segments, by last batch and then first."""
        found = [_NAME.match(n) for n in child_names(self.spark, self.path)]
        return sorted(((int(m[1]), int(m[2])) for m in found if m
                       and "_SUCCESS" in child_names(self.spark, os.path.join(self.path, m[0]))),
                      key=lambda s: (s[1], -s[0]))

    def current(self, before: int | None = None) -> list[Segment]:
        """The segments that make up the state (before a batch), oldest first:
        of those that end with one batch the longest."""
        out: list[Segment] = []
        for s in reversed([s for s in self.segments() if before is None or s[1] < before]):
            if not out or s[1] < out[-1][0]:
                longest = min((t for t in self.segments() if t[1] == s[1]), key=lambda t: t[0])
                out.append(longest)
        return out[::-1]

    def _read(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(self._folder(s)) for s in segments]
        if len(parts) == 1:
            return parts[0]
        aged = reduce(DataFrame.unionByName, [p.withColumn(_AGE, F.lit(i)) for i, p in enumerate(parts)])
        rest = F.struct(*[f.name for f in self.schema.fields if f.name not in self.keys])
        newest = aged.groupBy(*self.keys).agg(F.max_by(rest, F.col(_AGE)).alias("_s"))
        return newest.select(*[F.col(n) if n in self.keys else F.col("_s")[n].alias(n)
                               for n in self.schema.names])

    def read(self, before: int | None = None) -> DataFrame:
        """The state, or what it was before a batch."""
        return self._read(self.current(before))

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """The rows that ``batch_id`` changed, one per key, in their new state."""
        self._drop_merged(batch_id)
        now: Segment = (batch_id, batch_id)
        changed.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(now))
        older = self.current(batch_id)
        while older and self._bytes(older[-1]) < 2 * self._bytes(now):
            merged = (older[-1][0], batch_id)
            self._read([older.pop(), now]).write.mode("overwrite").parquet(self._folder(merged))
            now = merged

    def _bytes(self, s: Segment) -> int:
        return folder_bytes(self.spark, self._folder(s))

    def _drop_merged(self, batch_id: int) -> None:
        """Delete segments that one from before this batch has taken in."""
        live = set(self.current(batch_id))
        for s in self.segments():
            if s[1] < batch_id and s not in live:
                drop_path(self.spark, self._folder(s))
