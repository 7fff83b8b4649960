"""State of a foreachBatch stream as snapshots: one folder per micro-batch that
changed it, each the whole state. A batch reads the latest snapshot before it,
so a replayed batch starts where it did the first time; snapshots older than
the previous one are deleted, so a batch reads one folder and lists two,
however long the stream runs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rollcall.session import child_names, drop_path

_PREFIX = "batch_id="


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Batches with a complete snapshot, ascending."""
    ids = sorted(int(n[len(_PREFIX):]) for n in child_names(spark, path) if n.startswith(_PREFIX))
    return [i for i in ids if "_SUCCESS" in child_names(spark, snapshot_folder(path, i))]


def snapshot_folder(path: str, batch_id: int) -> str:
    return os.path.join(path, f"{_PREFIX}{batch_id}")


def read_snapshot(spark: SparkSession, path: str, schema: StructType,
                  before: int | None = None) -> DataFrame:
    """The latest state (before batch ``before``); empty at the start."""
    ids = [i for i in batch_ids(spark, path) if before is None or i < before]
    if not ids:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(snapshot_folder(path, ids[-1]))


def write_snapshot(state: DataFrame, path: str, batch_id: int) -> None:
    """Write the state after ``batch_id`` and drop what no replay can need."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(snapshot_folder(path, batch_id))
    for i in [i for i in batch_ids(spark, path) if i < batch_id][:-1]:
        drop_path(spark, snapshot_folder(path, i))
