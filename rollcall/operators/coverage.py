"""Q10: report coverage, the batch form of "wait until every node has called
home" (and J4, the nodes that have not).

Check-ins are first reduced per MAC (partial + final aggregate, so a chatty
MAC costs one row after the map side), then matched to the row each MAC
resolves to. Per cluster: nodes, reported, pending, and the cut-off: the
check-in at which the last node first reported; null while any is pending
(the wait would not have ended).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.expressions import mac_key
from rollcall.operators.inventory import first_row_per_mac
from rollcall.operators.scan import ordered_scan
from rollcall.session import cut_lineage


def first_checkin_per_mac(parsed_checkins: DataFrame) -> DataFrame:
    """(mac_key, first_seq) over check-ins with a MAC."""
    return (parsed_checkins.where(F.col("mac").isNotNull())
            .groupBy(mac_key("mac").alias("mac_key"))
            .agg(F.min("seq").alias("first_seq")))


def node_first_checkin(fleet: DataFrame, per_mac_first: DataFrame) -> DataFrame:
    """Every inventory row with ``first_seq`` (null: never reported; always
    null for a duplicate MAC row)."""
    matched = (first_row_per_mac(fleet)
               .join(per_mac_first, on="mac_key", how="inner")
               .select("cluster", "idx", "first_seq"))
    return fleet.join(matched, on=["cluster", "idx"], how="left")


def coverage_from_first(nodes: DataFrame) -> DataFrame:
    """Per cluster from node rows with ``first_seq``:
    (cluster, n, reported, pending, cutoff_seq)."""
    agg = nodes.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("first_seq").alias("reported"),
        F.max("first_seq").alias("_last_first"))
    pending = F.col("n") - F.col("reported")
    return agg.select(
        "cluster", "n", "reported", pending.alias("pending"),
        F.when(pending == 0, F.col("_last_first")).alias("cutoff_seq"))


def report_coverage(fleet: DataFrame, parsed_checkins: DataFrame) -> DataFrame:
    return coverage_from_first(
        node_first_checkin(fleet, first_checkin_per_mac(parsed_checkins)))


def not_reported(fleet: DataFrame, parsed_checkins: DataFrame) -> DataFrame:
    """J4: inventory rows with no check-in (cluster, idx, node, mac)."""
    nodes = node_first_checkin(fleet, first_checkin_per_mac(parsed_checkins))
    return nodes.where(F.col("first_seq").isNull()).select("cluster", "idx", "node", "mac")


def assign_runs(matched: DataFrame, runs: DataFrame, **scan_kw) -> DataFrame:
    """Matched check-ins (cluster, idx, seq) with the run of their cluster they
    fall into: the latest that started at or before them. Check-ins before a
    cluster's first run fall into none and go. An as-of join as one scan over
    starts and check-ins together, so a cluster with very many of either is split
    like any other (``scan``)."""
    starts = runs.select("cluster", F.lit(None).cast(matched.schema["idx"].dataType).alias("idx"),
                         F.col("start_seq").cast("long").alias("seq"), F.lit(0).alias("kind"), "run_id")
    events = matched.select("cluster", "idx", F.col("seq").cast("long").alias("seq"), F.lit(1).alias("kind"),
                            F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"))
    both = ordered_scan(starts.unionByName(events), ["cluster"], ["seq", "kind", "run_id"], "run_id", "run",
                        "last", **scan_kw)
    return (both.where((F.col("kind") == 1) & F.col("run").isNotNull())
            .select("cluster", "idx", "seq", F.col("run").alias("run_id")))


def coverage_by_run(fleet: DataFrame, parsed_checkins: DataFrame, runs: DataFrame, **scan_kw) -> DataFrame:
    """T4: coverage of every run (run_id, cluster, start_seq). Each starts empty,
    whatever earlier ones have seen, and consumes the check-ins from its start to
    the next run's of its cluster.
    Output: cluster, run_id, start_seq, n, reported, pending, cutoff_seq."""
    keys = cut_lineage(first_row_per_mac(fleet))
    matched = (parsed_checkins.where(F.col("mac").isNotNull())
               .select(F.col("seq").cast("long").alias("seq"), mac_key("mac").alias("mac_key"))
               .join(keys, on="mac_key", how="inner").select("cluster", "idx", "seq"))
    firsts = (assign_runs(matched, runs, **scan_kw).groupBy("cluster", "run_id", "idx")
              .agg(F.min("seq").alias("first_seq")))
    seen = firsts.groupBy("cluster", "run_id").agg(F.count(F.lit(1)).alias("reported"),
                                                   F.max("first_seq").alias("_last"))
    sizes = cut_lineage(fleet.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    reported = F.coalesce("reported", F.lit(0)).cast("long")
    return (runs.select("cluster", "run_id", F.col("start_seq").cast("long").alias("start_seq"))
            .join(sizes, "cluster", "inner").join(seen, ["cluster", "run_id"], "left")
            .select("cluster", "run_id", "start_seq", "n", reported.alias("reported"),
                    (F.col("n") - reported).alias("pending"),
                    F.when(reported == F.col("n"), F.col("_last")).alias("cutoff_seq")))
