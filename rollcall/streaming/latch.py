"""Q12s: the ordered wait over a stream of probes.

State is the latches so far, at most one per inventory row, kept as a log
(``rollcall.streaming.statelog``: a batch writes its new latches); where a cluster's
wait resumes (the next row, and the seq of the last latch) follows from them.
Each micro-batch runs the batch job (``rollcall.operators.convergence``), resumed there: only probes
of rows not yet latched, later than the last latch, enter it, and clusters
that are done none at all. A hot cluster is split over tasks inside the batch
as in the batch job, rather than walked by one task. A replayed batch reads the
state it read the first time, so it gives the same output.

The answer depends on the order of delivery: probes must arrive in seq order
across micro-batches (an event not later than the last latch of its cluster is
ignored). Where files or partitions come out of order, give a ``delay``: a reorder
buffer (``rollcall.streaming.reorder``) holds that much event time back, releases
it in order and puts what comes later still aside (``reorder_buffer(...).late()``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rollcall.operators.convergence import ordered_latch
from rollcall.operators.parse import parse_probes
from rollcall.session import cut_lineage
from rollcall.streaming.reorder import ReorderBuffer
from rollcall.streaming.statelog import StateLog


def state_schema(fleet: DataFrame) -> StructType:
    """Types of the state, from the inventory's (a cluster may be text)."""
    return StructType([fleet.schema["cluster"], StructField("idx", LongType()),
                       fleet.schema["node"], StructField("seq", LongType())])


def resume_points(fleet: DataFrame, latches: DataFrame) -> DataFrame:
    """(cluster, start_idx, after_seq) of the clusters that still wait."""
    sizes = fleet.groupBy("cluster").agg(F.max("idx").alias("_last"))
    done = latches.groupBy("cluster").agg(F.max("idx").alias("_idx"), F.max("seq").alias("after_seq"))
    start = F.coalesce(F.col("_idx") + 1, F.lit(0)).cast("long")
    return (sizes.join(done, on="cluster", how="left").withColumn("start_idx", start)
            .where(F.col("start_idx") <= F.col("_last"))
            .select("cluster", "start_idx", F.col("after_seq").cast("long").alias("after_seq")))


def _log(spark: SparkSession, fleet: DataFrame, state_path: str) -> StateLog:
    return StateLog(spark, os.path.join(state_path, "latches"), state_schema(fleet), ["cluster", "idx"])


def reorder_buffer(spark: SparkSession, state_path: str) -> ReorderBuffer:
    """The reorder buffer of a stream with ``delay``: its held and late probes."""
    return ReorderBuffer(spark, os.path.join(state_path, "reorder"))


def _advance(fleet: DataFrame, before: DataFrame, probes: DataFrame, target: bool, **scan_kw) -> DataFrame | None:
    """The latches that ``probes`` add; None where no cluster waits."""
    starts = cut_lineage(resume_points(fleet, before))
    if starts.isEmpty():
        return None
    return cut_lineage(ordered_latch(fleet, probes, target, starts=starts, **scan_kw))


def start_latch_stream(fleet: DataFrame, probes_stream: DataFrame, target: bool,
                       state_path: str, checkpoint_location: str,
                       trigger: dict | None = None, query_name: str | None = None,
                       delay: str | None = None, **scan_kw) -> StreamingQuery:
    """Start Q12s on a stream of raw probes (seq, ts, node, output)."""
    parsed = parse_probes(probes_stream)
    # the inventory is read by every micro-batch: written once, here
    fleet = cut_lineage(fleet.select("cluster", "idx", "node"))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch is read once: the latch job writes its target events first
        spark = batch.sparkSession
        if delay is not None:
            batch = reorder_buffer(spark, state_path).release(batch, batch_id, delay)
        log = _log(spark, fleet, state_path)
        latches = _advance(fleet, log.read(batch_id), batch, target, **scan_kw)
        if latches is not None and not latches.isEmpty():
            log.write(latches, batch_id)

    writer = (parsed.writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint_location)
              .foreachBatch(run_batch)
              .trigger(**(trigger or {"availableNow": True})))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def latches_from_state(spark: SparkSession, fleet: DataFrame, state_path: str,
                       held: DataFrame | None = None, target: bool = True, **scan_kw) -> DataFrame:
    """All latches written so far: (cluster, idx, node, seq); with ``held`` (the
    reorder buffer's rows) as if these had been released too."""
    latches = _log(spark, fleet, state_path).read()
    if held is not None:
        more = _advance(fleet, latches, held, target, **scan_kw)
        latches = latches if more is None else latches.unionByName(more)
    return latches.select("cluster", "idx", "node", "seq")
