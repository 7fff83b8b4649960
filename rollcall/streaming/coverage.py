"""Q10s: report coverage and the address patch, from a stream of check-ins.

The stream is parsed and, per micro-batch, matched to the inventory row of its
MAC. The state is one row per inventory row that has reported: first check-in,
number of check-ins consumed, the latest one with an address and that address;
it is kept as a log (``rollcall.streaming.statelog``), so a batch writes the rows
that its check-ins touch, and a replayed batch changes nothing. Check-ins that
match no row, or lack the MAC or the address, are the second output of a batch:
one folder each, overwritten by a replay (``unknown_from_state``).

Coverage needs no order: ``first_seq`` only ever goes down. The patch follows
the batch job (``state.apply_checkins``): a cluster consumes check-ins up to
its cut-off, the check-in at which its last row first reported. For that,
check-ins must arrive in seq order across micro-batches; within one any order
does. With ``delay`` a reorder buffer (``rollcall.streaming.reorder``) sees to
that; by default nothing is held back, and no check-in is ever too late.

Each run starts empty (the reference resets its flags): a run is a new
checkpoint and state folder.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rollcall.operators.coverage import coverage_from_first
from rollcall.operators.inventory import first_row_per_mac
from rollcall.operators.parse import parse_checkins
from rollcall.operators.state import matched_by_key, patch_rows, unknown_by_key
from rollcall.session import child_names, cut_lineage
from rollcall.streaming.reorder import ReorderBuffer
from rollcall.streaming.statelog import StateLog


def state_schema(fleet: DataFrame) -> StructType:
    """Types of the state, from the inventory's (a cluster may be text)."""
    return StructType([fleet.schema["cluster"], fleet.schema["idx"],
                       StructField("first_seq", LongType()), StructField("n_checkins", LongType()),
                       StructField("new_seq", LongType()), StructField("new_ip", StringType())])


def _log(spark: SparkSession, fleet: DataFrame, state_path: str) -> StateLog:
    return StateLog(spark, os.path.join(state_path, "rows"), state_schema(fleet), ["cluster", "idx"])


def _merge(fleet: DataFrame, state: DataFrame, matched: DataFrame) -> DataFrame:
    """The rows that the matched check-ins of one batch touch, after it."""
    key = ["cluster", "idx"]
    touched = cut_lineage(matched.groupBy(*key).agg(F.min("seq").alias("_first")))
    clusters = touched.select("cluster").distinct()
    # cut-offs of the clusters that the batch touches
    firsts = (state.join(clusters, "cluster", "left_semi").select(*key, "first_seq")
              .unionByName(touched.select(*key, F.col("_first").alias("first_seq")))
              .groupBy(*key).agg(F.min("first_seq").alias("first_seq")))
    nodes = fleet.join(clusters, "cluster", "left_semi").join(firsts, on=key, how="left")
    cutoffs = cut_lineage(coverage_from_first(nodes).select("cluster", "cutoff_seq"))
    consumed = (matched.join(cutoffs, on="cluster", how="inner")
                .where(F.col("cutoff_seq").isNull() | (F.col("seq") <= F.col("cutoff_seq"))))
    old = state.withColumnsRenamed(
        {"first_seq": "_old", "n_checkins": "_n", "new_seq": "_seq", "new_ip": "_ip"})
    newer = F.col("new_seq").isNotNull() & (F.col("_seq").isNull() | (F.col("new_seq") >= F.col("_seq")))
    return (touched.join(patch_rows(consumed), on=key, how="left").join(old, on=key, how="left")
            .select(*key, F.least("_first", "_old").alias("first_seq"),
                    (F.coalesce("n_checkins", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long")
                    .alias("n_checkins"),
                    F.when(newer, F.col("new_seq")).otherwise(F.col("_seq")).alias("new_seq"),
                    F.when(newer, F.col("new_ip")).otherwise(F.col("_ip")).alias("new_ip"),
                    F.col("_old").isNull().alias("is_new")))


class Coverage:
    """How far a running stream's wait has come, as its micro-batches tell it:
    nothing is read while one waits for it."""

    def __init__(self, rows: int):
        self.rows = rows
        self.reported: int | None = None
        self._changed = threading.Condition()

    def tell(self, reported: int | None = None) -> None:
        with self._changed:
            self.reported = reported if reported is not None else self.reported
            self._changed.notify_all()

    def full(self) -> bool:
        return self.reported is not None and self.reported >= self.rows

    def wait(self, until, timeout: float | None) -> bool:
        with self._changed:
            return self._changed.wait_for(until, timeout)


class _Ends(StreamingQueryListener):
    """Wakes whoever waits for a query when it ends by itself."""

    def __init__(self, coverage: Coverage, ended: threading.Event, query_id: str):
        self.coverage, self.ended, self.query_id = coverage, ended, query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.query_id:
            self.ended.set()
            self.coverage.tell()


def start_coverage_stream(fleet: DataFrame, checkins_stream: DataFrame, state_path: str,
                          checkpoint_location: str, trigger: dict | None = None,
                          query_name: str | None = None, delay: str | None = None) -> StreamingQuery:
    """Start Q10s; ``trigger`` as for ``DataStreamWriter.trigger`` (default
    availableNow)."""
    parsed = parse_checkins(checkins_stream)
    # read by every micro-batch: written once, here
    rows = cut_lineage(fleet.select("cluster", "idx"))
    keys = cut_lineage(first_row_per_mac(fleet))
    coverage = Coverage(rows.count())

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = _log(spark, rows, state_path)
        if delay is not None:
            batch = reorder_buffer(spark, state_path).release(batch, batch_id, delay)
        batch = cut_lineage(batch)
        aside = unknown_by_key(batch, keys)
        if not aside.isEmpty():
            aside.write.mode("overwrite").parquet(os.path.join(state_path, "unknown", f"batch_id={batch_id}"))
        if coverage.reported is None:
            coverage.reported = log.read(batch_id).count()
        matched = cut_lineage(matched_by_key(batch, keys))
        if matched.isEmpty():
            coverage.tell()
            return
        changed = cut_lineage(_merge(rows, log.read(batch_id), matched))
        log.write(changed.drop("is_new"), batch_id)
        coverage.tell(coverage.reported + changed.where("is_new").count())

    writer = (parsed.writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint_location)
              .foreachBatch(run_batch)
              .trigger(**(trigger or {"availableNow": True})))
    if query_name:
        writer = writer.queryName(query_name)
    query = writer.start()
    query.coverage = coverage
    return query


def reorder_buffer(spark: SparkSession, state_path: str) -> ReorderBuffer:
    """The reorder buffer of a stream with ``delay``: its held and late check-ins."""
    return ReorderBuffer(spark, os.path.join(state_path, "reorder"))


def unknown_from_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The check-ins set aside so far, as ``state.unknown_checkins`` has them:
    (seq, ts, ip, mac, reason)."""
    path = os.path.join(state_path, "unknown")
    if not child_names(spark, path):
        return spark.createDataFrame([], "seq long, ts timestamp, ip string, mac string, reason string")
    return spark.read.parquet(path).drop("batch_id")


def coverage_from_state(spark: SparkSession, fleet: DataFrame, state_path: str) -> DataFrame:
    """Coverage per cluster from what the stream has written so far:
    (cluster, n, reported, pending, cutoff_seq)."""
    firsts = _log(spark, fleet, state_path).read().select("cluster", "idx", "first_seq")
    return coverage_from_first(fleet.join(firsts, on=["cluster", "idx"], how="left"))


def inventory_from_state(spark: SparkSession, fleet: DataFrame, state_path: str) -> DataFrame:
    """The inventory as ``state.apply_checkins`` would patch it, from what the
    stream has written so far."""
    state = _log(spark, fleet, state_path).read().drop("first_seq", "new_seq")
    n = F.coalesce("n_checkins", F.lit(0)).cast("long")
    cols = [F.coalesce("new_ip", "ip").alias("ip") if c == "ip" else F.col(c) for c in fleet.columns]
    return (fleet.join(state, on=["cluster", "idx"], how="left")
            .select(*cols, (n > 0).alias("reported"), n.alias("n_checkins")))


def await_full_coverage(spark: SparkSession, query: StreamingQuery, fleet: DataFrame,
                        state_path: str, timeout_seconds: float | None = None) -> DataFrame:
    """The wait of T1 on a running stream of ``start_coverage_stream``: until its
    micro-batches have told that every row has reported, then stop the query.
    Returns the coverage (one row per cluster) at that point; on timeout, or
    when the query ends by itself, the coverage so far (``pending`` > 0 where the
    wait did not end). The state is read once, at the end."""
    coverage: Coverage = query.coverage
    ended = threading.Event()
    listener = _Ends(coverage, ended, str(query.runId))
    spark.streams.addListener(listener)
    try:
        coverage.wait(lambda: coverage.full() or ended.is_set() or not query.isActive, timeout_seconds)
    finally:
        spark.streams.removeListener(listener)
    if coverage.full() and query.isActive:
        query.stop()
    return coverage_from_state(spark, fleet, state_path)
