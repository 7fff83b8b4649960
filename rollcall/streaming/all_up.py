"""Q11s: the first moment at which every row of a cluster is up, from a stream of
probes.

State is two logs (``rollcall.streaming.statelog``): the last state of each
inventory row that has been up, and per cluster the number of rows up and, once
reached, the moment of the answer. A micro-batch turns its probes into signed
changes by the batch job's scan, with the rows' last states as their first
events, and runs the clusters' counts on with the scan of the changes, which begins
at the count so far; so a hot cluster or row is split over tasks as in the batch
job. Clusters that have been all up are done: the wait has ended, their probes go
no further. A batch writes the rows that changed and their clusters only.

Order within a micro-batch is the batch job's, (ts, seq) and at one moment down
before up. Across micro-batches probes must come in order; with ``delay`` a reorder
buffer (``rollcall.streaming.reorder``) sees to that.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampType

from rollcall.operators.convergence import probes_of_fleet
from rollcall.operators.parse import parse_probes
from rollcall.operators.scan import ordered_scan
from rollcall.operators.state import cluster_sizes
from rollcall.session import cut_lineage
from rollcall.streaming.reorder import ReorderBuffer
from rollcall.streaming.statelog import StateLog

_ROW = ["cluster", "idx"]


def _logs(spark: SparkSession, fleet: DataFrame, path: str) -> tuple[StateLog, StateLog]:
    """Rows (cluster, idx, u) and clusters (cluster, n_up, moment)."""
    cluster, idx = fleet.schema["cluster"], fleet.schema["idx"]
    rows = StructType([cluster, idx, StructField("u", IntegerType())])
    clusters = StructType([cluster, StructField("n_up", LongType()),
                           StructField("all_up_at", TimestampType()), StructField("all_up_seq", LongType())])
    return (StateLog(spark, os.path.join(path, "rows"), rows, _ROW),
            StateLog(spark, os.path.join(path, "clusters"), clusters, ["cluster"]))


def _null(name: str, df: DataFrame):
    return F.lit(None).cast(df.schema[name].dataType).alias(name)


def advance(fleet: DataFrame, sizes: DataFrame, batch: DataFrame, rows: DataFrame, clusters: DataFrame,
            **scan_kw) -> tuple[DataFrame, DataFrame] | None:
    """What a batch of parsed probes changes: rows and clusters in their new
    state; None when it has no probe of a cluster that still waits."""
    done = clusters.where(F.col("all_up_seq").isNotNull()).select("cluster")
    probes = cut_lineage(probes_of_fleet(fleet, batch).join(done, "cluster", "left_anti"))
    if probes.isEmpty():
        return None
    last = probes.groupBy(*_ROW).agg(F.max(F.struct("ts", "seq", "u"))["u"].alias("u"))
    known = rows.join(last.select(*_ROW), _ROW, "left_semi")
    # a row's last state stands before its probes: no time sorts first
    first = known.select(*_ROW, _null("ts", probes), _null("seq", probes), "u")
    seen = ordered_scan(probes.unionByName(first), _ROW, ["ts", "seq", "u"], "u", "before", "previous", **scan_kw)
    changes = cut_lineage(
        seen.where(F.col("seq").isNotNull())
        .select(*_ROW, "ts", "seq", (F.col("u") - F.coalesce("before", F.lit(0))).cast("long").alias("delta"))
        .where(F.col("delta") != 0))
    net = changes.groupBy("cluster").agg(F.sum("delta").alias("net"))
    counts = cut_lineage(net.join(clusters.select("cluster", "n_up"), "cluster", "left")
                         .select("cluster", "net", F.coalesce("n_up", F.lit(0)).cast("long").alias("n_up")))
    start = counts.select("cluster", F.lit(-1).cast(changes.schema["idx"].dataType).alias("idx"),
                          _null("ts", changes), _null("seq", changes), F.col("n_up").alias("delta"))
    running = ordered_scan(changes.unionByName(start), ["cluster"], ["ts", "seq", "idx", "delta"], "delta",
                           "n_up", "running_sum", **scan_kw)
    hit = (running.where(F.col("seq").isNotNull())
           .join(sizes.select("cluster", F.col("n").alias("n_up")), ["cluster", "n_up"], "inner")
           .groupBy("cluster").agg(F.min(F.struct("ts", "seq")).alias("_f")))
    new_clusters = (counts.join(hit, "cluster", "left")
                    .select("cluster", (F.col("n_up") + F.col("net")).alias("n_up"),
                            F.col("_f.ts").alias("all_up_at"), F.col("_f.seq").alias("all_up_seq")))
    # a row that has never been up needs no state
    new_rows = (last.join(known.withColumnRenamed("u", "_u"), _ROW, "left")
                .where(F.col("u") != F.coalesce("_u", F.lit(0))).select(*_ROW, F.col("u").cast("int").alias("u")))
    return new_rows, new_clusters


def reorder_buffer(spark: SparkSession, state_path: str) -> ReorderBuffer:
    """The reorder buffer of a stream with ``delay``: its held and late probes."""
    return ReorderBuffer(spark, os.path.join(state_path, "reorder"))


def start_all_up_stream(fleet: DataFrame, probes_stream: DataFrame, state_path: str,
                        checkpoint_location: str, trigger: dict | None = None,
                        query_name: str | None = None, delay: str | None = None,
                        **scan_kw) -> StreamingQuery:
    """Start Q11s on a stream of raw probes (seq, ts, node, output)."""
    parsed = parse_probes(probes_stream)
    # read by every micro-batch: written once, here
    fleet = cut_lineage(fleet.select("cluster", "idx", "node"))
    sizes = cut_lineage(cluster_sizes(fleet))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if delay is not None:
            batch = reorder_buffer(spark, state_path).release(batch, batch_id, delay)
        rows, clusters = _logs(spark, fleet, state_path)
        changed = advance(fleet, sizes, batch, rows.read(batch_id), cut_lineage(clusters.read(batch_id)), **scan_kw)
        if changed is not None:
            rows.write(changed[0], batch_id)
            clusters.write(changed[1], batch_id)

    writer = (parsed.writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint_location)
              .foreachBatch(run_batch)
              .trigger(**(trigger or {"availableNow": True})))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def all_up_from_state(spark: SparkSession, fleet: DataFrame, state_path: str,
                      held: DataFrame | None = None, **scan_kw) -> DataFrame:
    """(cluster, n, all_up_at, all_up_seq) as ``convergence.all_up_at`` has it, from
    what the stream has seen; with ``held`` (the reorder buffer's rows) as if
    these had been released too."""
    rows, clusters = _logs(spark, fleet, state_path)
    sizes = cluster_sizes(fleet)
    found = clusters.read()
    if held is not None:
        changed = advance(fleet, sizes, held, rows.read(), cut_lineage(found), **scan_kw)
        if changed is not None:
            now = cut_lineage(changed[1])
            found = found.join(now.select("cluster"), "cluster", "left_anti").unionByName(now)
    return (sizes.join(found.select("cluster", "all_up_at", "all_up_seq"), "cluster", "left")
            .select("cluster", "n", "all_up_at", "all_up_seq"))
