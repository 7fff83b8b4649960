"""Q4-Q8: patching the inventory from check-ins, the state report, power
source, node selections and per-node context.

Pattern throughout: reduce the big side (probes, check-ins) with a partial +
final aggregate to one row per node or MAC first, then join to the inventory.
Sides that are aggregates (the row of a MAC, the head of a cluster, its size)
are written before they meet a table with hot keys (``split_side``), so that
AQE broadcasts them at their measured size or splits a hot key. No window spans
a whole cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import expressions as X
from rollcall.operators.coverage import coverage_from_first
from rollcall.operators.inventory import first_row_per_mac
from rollcall.session import cut_lineage, split_side


# -- Q4 / Q4b -----------------------------------------------------------------

def apply_checkins(fleet: DataFrame, parsed_checkins: DataFrame,
                   update: bool = True) -> DataFrame:
    """The inventory after the check-ins of one wait.

    Each cluster consumes check-ins up to its cut-off (all of them while the
    wait would not end). For a matched row: the address of its latest
    check-in with an address replaces ``ip`` when ``update``; ``reported``
    and ``n_checkins`` count what was consumed.
    Output: the inventory's columns (``ip`` patched), reported, n_checkins;
    it can be passed on as the inventory (e.g. to ``node_context``).
    """
    # one pass over the check-ins: those that resolve to a row, written once
    # (narrow), serve the cut-offs and the patch
    matched = cut_lineage(matched_checkins(fleet, parsed_checkins))
    firsts = matched.groupBy("cluster", "idx").agg(F.min("seq").alias("first_seq"))
    nodes = fleet.select("cluster", "idx").join(firsts, on=["cluster", "idx"], how="left")
    cutoffs = split_side(coverage_from_first(nodes).select("cluster", "cutoff_seq"))
    consumed = (matched.join(cutoffs, on="cluster", how="inner")
                .where(F.col("cutoff_seq").isNull() | (F.col("seq") <= F.col("cutoff_seq"))))
    per_node = patch_rows(consumed)
    out = fleet.join(per_node, on=["cluster", "idx"], how="left")
    ip = F.coalesce("new_ip", "ip") if update else F.col("ip")
    n = F.coalesce("n_checkins", F.lit(0)).cast("long")
    cols = [ip.alias("ip") if c == "ip" else F.col(c) for c in fleet.columns]
    return out.select(*cols, (n > 0).alias("reported"), n.alias("n_checkins"))


def matched_checkins(fleet: DataFrame, parsed_checkins: DataFrame) -> DataFrame:
    """Check-ins with a known MAC and the row it resolves to:
    (cluster, idx, seq, ip)."""
    return matched_by_key(parsed_checkins, split_side(first_row_per_mac(fleet)))


def matched_by_key(parsed_checkins: DataFrame, keys: DataFrame) -> DataFrame:
    """``matched_checkins`` with the rows MACs resolve to given as a written
    table (mac_key, cluster, idx)."""
    return (parsed_checkins.where(F.col("mac").isNotNull())
            .select(F.col("seq").cast("long").alias("seq"), "ip", X.mac_key("mac").alias("mac_key"))
            .join(keys, on="mac_key", how="inner")
            .select("cluster", "idx", "seq", "ip"))


def patch_rows(consumed: DataFrame) -> DataFrame:
    """Per row of the consumed check-ins (cluster, idx, seq, ip): new_seq and
    new_ip, the latest check-in with an address (of several with one seq, the
    greatest address), and n_checkins. The reduction is on numbers only, so it
    is a hash aggregate; the address is looked up by seq."""
    last = consumed.groupBy("cluster", "idx").agg(
        F.max(F.when(F.col("ip").isNotNull(), F.col("seq"))).alias("new_seq"),
        F.count(F.lit(1)).alias("n_checkins"))
    found = (consumed.where(F.col("ip").isNotNull())
             .join(last.select("cluster", "idx", F.col("new_seq").alias("seq")),
                   on=["cluster", "idx", "seq"], how="inner")
             .groupBy("cluster", "idx").agg(F.max("ip").alias("new_ip")))
    return last.join(found, on=["cluster", "idx"], how="left")


def unknown_checkins(fleet: DataFrame, parsed_checkins: DataFrame) -> DataFrame:
    """Check-ins set aside: no MAC, a MAC no inventory row has, or a known
    MAC without an address. One row per check-in, first reason wins.
    Output: seq, ts, ip, mac, reason."""
    return unknown_by_key(parsed_checkins, split_side(first_row_per_mac(fleet).select("mac_key")))


def unknown_by_key(parsed_checkins: DataFrame, keys: DataFrame) -> DataFrame:
    """``unknown_checkins`` with the known MACs given as a written table
    (mac_key)."""
    cols = ["seq", "ts", "ip", "mac"]
    # a null MAC matches nothing: those check-ins never enter the join
    no_mac = parsed_checkins.where(F.col("mac").isNull()).select(
        *cols, F.lit("no_mac").alias("reason"))
    known = keys.select("mac_key", F.lit(True).alias("_known"))
    reason = (F.when(F.col("_known").isNull(), F.lit("unknown_mac"))
              .when(F.col("ip").isNull(), F.lit("no_ip")))
    return no_mac.unionByName(
        parsed_checkins.where(F.col("mac").isNotNull())
        .withColumn("mac_key", X.mac_key("mac"))
        .join(known, on="mac_key", how="left")
        .select(*cols, reason.alias("reason"))
        .where(F.col("reason").isNotNull()))


# -- Q5 -------------------------------------------------------------------------

def latest_probe(parsed_probes: DataFrame) -> DataFrame:
    """Per node: state of its latest probe (node, up, last_seq); of probes
    with one seq, up comes after down. One number per probe holds both, so the
    reduction is a hash aggregate."""
    last = F.max(F.col("seq") * 2 + F.col("up").cast("long")).alias("_last")
    return parsed_probes.groupBy("node").agg(last).select(
        "node", (F.col("_last") % 2 == 1).alias("up"), F.shiftright("_last", 1).alias("last_seq"))


def cluster_sizes(fleet: DataFrame) -> DataFrame:
    return fleet.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def node_up(fleet: DataFrame, parsed_probes: DataFrame) -> DataFrame:
    """The inventory with ``up``: the state of the node's latest probe (no
    probe = down)."""
    latest = latest_probe(parsed_probes).select("node", "up")
    return (fleet.join(latest, on="node", how="left")
            .withColumn("up", F.coalesce("up", F.lit(False))))


def fleet_state(fleet: DataFrame, parsed_probes: DataFrame) -> DataFrame:
    """Per node: latest probe state (no probe = down) and the report line.
    Output: cluster, idx, node, mac, ip, is_master, n, up, line."""
    state = node_up(fleet, parsed_probes).join(
        split_side(cluster_sizes(fleet)), on="cluster", how="inner")
    line = X.state_line("up", "is_master", "idx", "n", "mac", "ip")
    return state.select("cluster", "idx", "node", "mac", "ip",
                        X.truthy("is_master").alias("is_master"), "n", "up",
                        line.alias("line"))


def cluster_state(node_state: DataFrame) -> DataFrame:
    """Per cluster: n, n_up, all_up (every node's latest probe is up)."""
    return node_state.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("up").alias("n_up"),
        F.bool_and("up").alias("all_up"))


# -- Q6 -------------------------------------------------------------------------

def power_source(fleet: DataFrame) -> DataFrame:
    """Nodes per (cluster, source): wol / remote / local / null."""
    src = X.power_source("is_physical", "nc", "path").alias("source")
    return fleet.groupBy("cluster", src).agg(F.count(F.lit(1)).alias("n"))


def node_power(fleet: DataFrame) -> DataFrame:
    """Per node: how it is powered on and what that needs."""
    return fleet.select("cluster", "idx", "node", "mac",
                        X.power_source("is_physical", "nc", "path").alias("source"),
                        "nc", "vmware", "path")


# -- Q8 -------------------------------------------------------------------------

def head_nodes(fleet: DataFrame) -> DataFrame:
    """Per cluster: the first node flagged master (null when none)."""
    first = F.min(F.when(X.truthy("is_master"), F.struct("idx", "ip")))
    return (fleet.groupBy("cluster").agg(first.alias("_h"))
            .select("cluster", F.col("_h.idx").alias("head_idx"),
                    F.col("_h.ip").alias("head_ip")))


def node_context(fleet: DataFrame) -> DataFrame:
    """What each node's commands are built from: its role, the head node's
    index and address, and its entry in the peer listings (the listings
    themselves are these entries in idx order; see sinks.write_listings).
    Output: cluster, idx, node, ip, role, head_idx, head_ip, dns_entry,
    hosts_entry."""
    ctx = fleet.join(split_side(head_nodes(fleet)), on="cluster", how="left")
    return ctx.select("cluster", "idx", "node", "ip", X.role("is_master").alias("role"),
                      "head_idx", "head_ip",
                      X.dns_entry("ip", "idx").alias("dns_entry"),
                      X.hosts_entry("ip", "idx").alias("hosts_entry"))


def running_context(fleet: DataFrame, parsed_probes: DataFrame) -> DataFrame:
    """``node_context`` of the nodes whose latest probe is up: what the
    commands that act on running nodes are built from."""
    running = node_up(fleet, parsed_probes).where("up").select("cluster", "idx")
    return node_context(fleet).join(running, on=["cluster", "idx"], how="left_semi")


# -- Q7 -------------------------------------------------------------------------

SELECT_MODES = ("all", "running", "head")


def select_nodes(node_state: DataFrame, mode: str, heads: DataFrame | None = None) -> DataFrame:
    """Nodes an action runs on, from rows with ``up`` (``node_up``): ``all``; ``running`` (latest probe up);
    ``head`` (the cluster's head node, none when the cluster has none).
    Output: cluster, idx, node, ip."""
    cols = ["cluster", "idx", "node", "ip"]
    if mode == "all":
        return node_state.select(*cols)
    if mode == "running":
        return node_state.where(F.col("up")).select(*cols)
    if mode == "head":
        if heads is None:
            raise ValueError("mode 'head' needs head_nodes(fleet)")
        h = heads.where(F.col("head_idx").isNotNull()).select(
            "cluster", F.col("head_idx").alias("idx"))
        return node_state.join(h, on=["cluster", "idx"], how="inner").select(*cols)
    raise ValueError(f"mode must be one of {SELECT_MODES}")
