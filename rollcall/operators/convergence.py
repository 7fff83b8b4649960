"""Q11 and Q12: when a cluster converged, from the probe log.

A node id may stand on several inventory rows; a probe of it counts for each.
Everything is keyed by the inventory row (cluster, idx).

Q11 ``all_up_at``: the first probe at which every row of a cluster has its
latest probe up. Per row, only changes of state matter (+1 when it comes up,
-1 when it goes down); a running sum of those changes per cluster is the
number of rows up, and the answer is the first change where it reaches the
cluster size. Probes are ordered by (ts, seq), those of one row at the same
moment with down before up, and changes of several rows at the same moment by
idx. Both the per-row "previous state" and the per-cluster running sum are
``ordered_scan``s, which stay parallel when one node or one cluster holds most
of the log.

Q12 ``ordered_latch``: wait for node 0 to be in the target state, then node
1, ...; an event of the node being waited for in the target state latches it
and moves the wait to the next node. With E_i the target events of row i,
latch L_i = min{e in E_i : e > L_(i-1)} by seq, strictly: events with one seq
are simultaneous, and a wait moves on by one row at a time. That chain is
computed without walking a cluster's log in one task. All tables are keyed by
(cluster, off, seq), with off = idx - the row the wait starts at:

* ``succ(e)`` for an event e at off is the first event at off+1 after it (an
  ``ordered_scan`` "min over following rows" over the events of both, where at
  one seq candidates come before the events that ask). L_(i+1) = succ(L_i).
* pointer doubling: J_0 = succ, J_(r+1)(e) = J_r(J_r(e)), a join of J_r with
  itself, checkpointed. J_r is looked up at offsets that are multiples of 2^r
  only, so only those rows are kept: the tables halve from level to level, two
  event tables in all. Chains merge, so many events can share a target; such a
  key is split by AQE's skew join, as both sides are written tables.
* from L_start, positions are filled from the highest jump down: every known
  position looks up J_r and gives itself and the position 2^r further on. The
  known positions are at most one row per node.

Work is O(E). Steps keyed by row are skew-proof scans or joins of written
tables, so a cluster or node holding most of the events is spread like any
other data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.scan import ordered_scan, split_decision
from rollcall.operators.state import cluster_sizes
from rollcall.session import cut_lineage


# -- Q11 ------------------------------------------------------------------------

def probes_of_fleet(fleet: DataFrame, parsed_probes: DataFrame) -> DataFrame:
    """The probes of each inventory row: (cluster, idx, ts, seq, u)."""
    return (parsed_probes.join(fleet.select("node", "cluster", "idx"), on="node", how="inner")
            .select("cluster", "idx", "ts", "seq", F.col("up").cast("int").alias("u")))


def state_changes(fleet: DataFrame, parsed_probes: DataFrame, **scan_kw) -> DataFrame:
    """Probes of inventory rows where the row's state changed:
    (cluster, idx, ts, seq, delta) with delta +1 (came up) or -1 (went
    down). A row starts down."""
    return _changes(probes_of_fleet(fleet, parsed_probes), **scan_kw)


def _changes(probes: DataFrame, **scan_kw) -> DataFrame:
    prev = ordered_scan(probes, ["cluster", "idx"], ["ts", "seq", "u"], "u", "prev_u", "previous",
                        **scan_kw)
    delta = F.col("u") - F.coalesce(F.col("prev_u"), F.lit(0))
    return (prev.select("cluster", "idx", "ts", "seq", delta.alias("delta"))
            .where(F.col("delta") != 0))


def _probe_counts(fleet: DataFrame, parsed_probes: DataFrame):
    """(most probes of a row, most of a cluster, all): counted per node on the
    log with a map-side combine, then joined with the inventory."""
    per_node = parsed_probes.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    return (per_node.join(fleet.select("node", "cluster"), "node")
            .groupBy("cluster").agg(F.sum("k").alias("c"), F.max("k").alias("m"))
            .agg(F.max("m").alias("row_max"), F.max("c").alias("cluster_max"),
                 F.sum("c").alias("total"))
            .first())


def all_up_at(fleet: DataFrame, parsed_probes: DataFrame, **scan_kw) -> DataFrame:
    """Per cluster: n, and the ts and seq of the first probe after which all
    n rows are up (null when that never happens).
    Output: cluster, n, all_up_at, all_up_seq."""
    probes = probes_of_fleet(fleet, parsed_probes)
    row_kw, cluster_kw = dict(scan_kw), dict(scan_kw)
    if scan_kw.get("split") is None:
        st = _probe_counts(fleet, parsed_probes)
        total = int(st["total"] or 0)
        mgr = scan_kw.get("max_group_rows")
        row_kw["split"], row_kw["num_chunks"] = split_decision(
            probes, int(st["row_max"] or 0), total, mgr)
        cluster_kw["split"], cluster_kw["num_chunks"] = split_decision(
            probes, int(st["cluster_max"] or 0), total, mgr)
    if row_kw.get("split"):
        # the chunked scan samples its input, then shuffles it: write the
        # joined probes once
        probes = cut_lineage(probes)
    changes = _changes(probes, **row_kw)
    if cluster_kw.get("split"):
        changes = cut_lineage(changes)
    counted = ordered_scan(changes, ["cluster"], ["ts", "seq", "idx", "delta"], "delta", "n_up",
                           "running_sum", **cluster_kw)
    sizes = cluster_sizes(fleet)
    # equi-join on (cluster, n_up = n): only the all-up moments meet the join
    full = sizes.select("cluster", F.col("n").alias("n_up"))
    first = (counted.join(full, on=["cluster", "n_up"], how="inner")
             .groupBy("cluster").agg(F.min(F.struct("ts", "seq")).alias("_f")))
    return (sizes.join(first, on="cluster", how="left")
            .select("cluster", "n", F.col("_f.ts").alias("all_up_at"),
                    F.col("_f.seq").alias("all_up_seq")))


# -- Q12 ------------------------------------------------------------------------

def wait_events(fleet: DataFrame, parsed_probes: DataFrame, target: bool,
                starts: DataFrame) -> DataFrame:
    """Probes in the target state of the rows a wait can still reach:
    (cluster, off, seq), off = idx - start_idx, later than ``after_seq``."""
    rows = (fleet.select("cluster", "idx", "node").join(starts, on="cluster", how="inner")
            .where(F.col("idx") >= F.col("start_idx"))
            .select("node", "cluster", (F.col("idx") - F.col("start_idx")).cast("long").alias("off"),
                    "after_seq"))
    return (parsed_probes.where(F.col("up") == F.lit(target)).select("node", "seq")
            .join(rows, on="node", how="inner")
            .where(F.col("after_seq").isNull() | (F.col("seq") > F.col("after_seq")))
            .select("cluster", "off", F.col("seq").cast("long").alias("seq")))


def successor_events(events: DataFrame, **scan_kw) -> DataFrame:
    """For each event (cluster, off, seq): ``to``, the seq of the first event
    at off+1 after it; events without one are absent."""
    asks = events.select("cluster", F.col("off").alias("k"), "seq",
                         F.lit(None).cast("long").alias("cand"), F.lit(1).alias("q"))
    cands = events.where(F.col("off") > 0).select(
        "cluster", (F.col("off") - 1).alias("k"), "seq", F.col("seq").alias("cand"),
        F.lit(0).alias("q"))
    nxt = ordered_scan(asks.unionByName(cands), ["cluster", "k"], ["seq", "q"], "cand", "to",
                       "min_following", **scan_kw)
    return (nxt.where((F.col("q") == 1) & F.col("to").isNotNull())
            .select("cluster", F.col("k").alias("off"), "seq", "to").distinct())


def _jumps(events: DataFrame, longest: int, **scan_kw) -> list[DataFrame]:
    """J_0, J_1, ...: (cluster, off, seq, to) with to the seq 2^r rows on, for
    offsets that are multiples of 2^r; up to the longest chain."""
    jumps: list[DataFrame] = []
    while (1 << len(jumps)) < longest:
        r = len(jumps)
        if not jumps:
            jump = successor_events(events, **scan_kw)
        else:
            step = 1 << (r - 1)
            here = jumps[-1].where(F.col("off") % (2 * step) == 0)
            there = jumps[-1].where(F.col("off") % (2 * step) == step).select(
                "cluster", (F.col("off") - step).alias("off"), F.col("seq").alias("to"),
                F.col("to").alias("to2"))
            jump = (here.join(there, on=["cluster", "off", "to"], how="inner")
                    .select("cluster", "off", "seq", F.col("to2").alias("to")))
        jump = cut_lineage(jump)
        if jump.isEmpty():       # no chain is that long
            break
        jumps.append(jump)
    return jumps


def ordered_latch(fleet: DataFrame, parsed_probes: DataFrame, target: bool = True,
                  starts: DataFrame | None = None, **scan_kw) -> DataFrame:
    """The ordered wait: per cluster, each node in idx order with the seq of
    the probe that latched it in the target state (up for ``True``, down for
    ``False``). Nodes after the first one that never gets there are absent.

    ``starts`` (cluster, start_idx[, after_seq]) resumes a wait at row
    start_idx, counting only events after ``after_seq`` (used by the stream,
    whose state is this pointer); default: every cluster from row 0.
    ``seq`` is the order of the probes; probes may share one.
    Output: cluster, idx, node, seq.
    """
    if starts is None:
        starts = fleet.select("cluster").distinct().withColumn("start_idx", F.lit(0).cast("long"))
    if "after_seq" not in starts.columns:
        starts = starts.withColumn("after_seq", F.lit(None).cast("long"))
    # read several times (size check, successor scan, first events): written once
    events = cut_lineage(wait_events(fleet, parsed_probes, target, starts))
    longest = int(events.agg(F.max("off")).first()[0] or 0) + 1
    jumps = _jumps(events, longest, **scan_kw)
    known = (events.where(F.col("off") == 0).groupBy("cluster").agg(F.min("seq").alias("seq"))
             .select("cluster", F.lit(0).cast("long").alias("off"), "seq"))
    for r in reversed(range(len(jumps))):
        # known: offsets that are multiples of 2^(r+1)
        table = jumps[r].where(F.col("off") % (2 << r) == 0)
        here = F.struct("off", "seq")
        on = F.struct((F.col("off") + (1 << r)).alias("off"), F.col("to").alias("seq"))
        both = F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, on))
        known = (known.join(table, on=["cluster", "off", "seq"], how="left")
                 .select("cluster", F.explode(both).alias("p"))
                 .select("cluster", "p.off", "p.seq"))
    return (known.join(starts.select("cluster", "start_idx"), on="cluster", how="inner")
            .select("cluster", (F.col("off") + F.col("start_idx")).cast("long").alias("idx"), "seq")
            .join(fleet.select("cluster", "idx", "node"), on=["cluster", "idx"], how="inner")
            .select("cluster", "idx", "node", "seq"))
