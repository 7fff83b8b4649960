"""Named jobs over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry reads the Parquet tables of ``sf_dir`` through the views of
``rollcall.sources.views`` and runs one job of the library on the whole of
them. The equivalent DuckDB SQL is in ``rollcall.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators import convergence, coverage, inventory, parse, state
from rollcall.session import scratch_path
from rollcall.sources import sinks, views
from rollcall.sources.inventory import read_inventory
from rollcall.sources.streams import table_stream
from rollcall.streaming import all_up as all_up_stream
from rollcall.streaming import coverage as coverage_stream
from rollcall.streaming import latch as latch_stream

Query = Callable[[SparkSession, str], DataFrame]


def _pc(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_checkins(views.checkins(spark, d))


def _pp(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_probes(views.probes(spark, d))


def fleet_scan_shared(spark, d):
    return inventory.flag_duplicate_macs(views.shared_macs(views.fleet(spark, d)))


def fleet_scan_json(spark, d, split=None):
    """The fleet written as one commented JSON array per cluster, read back by
    the inventory reader, with the duplicate flag."""
    path = scratch_path(spark, "inventory-json")
    fleet = views.fleet(spark, d)
    views.write_inventory_json(fleet, path)
    back = read_inventory(spark, path, split=split).withColumn("cluster", F.col("cluster").cast(
        fleet.schema["cluster"].dataType))
    ids = fleet.select("cluster", "idx", F.col("node").alias("_node"))
    named = back.join(ids, ["cluster", "idx"]).withColumn("node", F.col("_node"))
    return inventory.flag_duplicate_macs(named.select(*fleet.columns))


def fleet_scan_json_split(spark, d):
    """The same with files split within the array."""
    return fleet_scan_json(spark, d, split=True)


def fleet_scan(spark, d):
    return inventory.flag_duplicate_macs(views.fleet(spark, d))


def parse_checkins(spark, d):
    return _pc(spark, d)


def parse_probes(spark, d):
    return _pp(spark, d)


def apply_checkins(spark, d):
    return state.apply_checkins(views.fleet(spark, d), _pc(spark, d), update=True)


def apply_checkins_shared(spark, d):
    return state.apply_checkins(views.shared_macs(views.fleet(spark, d)), _pc(spark, d))


def apply_checkins_stream(spark, d):
    """The address patch of the check-in stream, to the end."""
    fleet = views.fleet(spark, d)
    base = scratch_path(spark, "patch-stream")
    q = coverage_stream.start_coverage_stream(
        fleet, views.checkins_from(table_stream(spark, d, "events")),
        base + "/state", base + "/checkpoint")
    q.awaitTermination()
    return coverage_stream.inventory_from_state(spark, fleet, base + "/state")


def apply_checkins_keep_ip(spark, d):
    return state.apply_checkins(views.fleet(spark, d), _pc(spark, d), update=False)


def unknown_checkins(spark, d):
    return state.unknown_checkins(views.fleet(spark, d), _pc(spark, d))


def fleet_state(spark, d):
    return state.fleet_state(views.fleet(spark, d), _pp(spark, d))


def cluster_state(spark, d):
    return state.cluster_state(state.node_up(views.fleet(spark, d), _pp(spark, d)))


def power_source(spark, d):
    return state.power_source(views.fleet(spark, d))


def node_power(spark, d):
    return state.node_power(views.fleet(spark, d))


def _select(mode: str) -> Query:
    def run(spark, d):
        fleet = views.fleet(spark, d)
        node_state = state.node_up(fleet, _pp(spark, d))
        heads = state.head_nodes(fleet) if mode == "head" else None
        return state.select_nodes(node_state, mode, heads)
    run.__name__ = f"select_{mode}"
    return run


def node_context(spark, d):
    return state.node_context(views.fleet(spark, d))


def running_context(spark, d):
    return state.running_context(views.fleet(spark, d), _pp(spark, d))


def report_coverage(spark, d):
    return coverage.report_coverage(views.fleet(spark, d), _pc(spark, d))


def report_coverage_wide(spark, d):
    return coverage.report_coverage(views.fleet_wide(spark, d), _pc(spark, d))


def report_coverage_runs(spark, d):
    """Several waits over one log: each run of a cluster starts empty."""
    return coverage.coverage_by_run(views.fleet(spark, d), _pc(spark, d), views.runs(spark, d))


def report_coverage_runs_split(spark, d):
    """The same by the chunked scan, as for a cluster that no task can hold."""
    return coverage.coverage_by_run(views.fleet(spark, d), _pc(spark, d), views.runs(spark, d),
                                    split=True, num_chunks=8)


def not_reported(spark, d):
    return coverage.not_reported(views.fleet(spark, d), _pc(spark, d))


def not_reported_wide(spark, d):
    return coverage.not_reported(views.fleet_wide(spark, d), _pc(spark, d))


def all_up_at_wide(spark, d):
    return convergence.all_up_at(views.fleet_wide(spark, d), _pp(spark, d))


def all_up_at_shared(spark, d):
    """Node ids that stand on several inventory rows, in a coarse order."""
    return convergence.all_up_at(views.shared_nodes(views.fleet(spark, d)),
                                 views.coarse_seq(_pp(spark, d)))


def all_up_at(spark, d):
    return convergence.all_up_at(views.fleet(spark, d), _pp(spark, d))


def latch_on(spark, d):
    return convergence.ordered_latch(views.fleet(spark, d), _pp(spark, d), target=True)


def latch_on_wide(spark, d):
    return convergence.ordered_latch(views.fleet_wide(spark, d), _pp(spark, d), target=True)


def _latch_ties(target: bool) -> Query:
    def run(spark, d):
        return convergence.ordered_latch(views.fleet(spark, d), views.coarse_seq(_pp(spark, d)), target)
    run.__name__ = f"latch_{'on' if target else 'off'}_ties"
    return run


def latch_off(spark, d):
    return convergence.ordered_latch(views.fleet(spark, d), _pp(spark, d), target=False)


def export_state(spark, d):
    """Q9: the state report written as JSON per cluster and read back, with each
    row's place in its cluster's files."""
    report = fleet_state(spark, d)
    path = scratch_path(spark, "export-state")
    sinks.export_table(report, path, fmt="json")
    return sinks.read_export(spark, path, report.schema, fmt="json", position=True)


def export_hosts(spark, d):
    """Q9: the hosts listing written per cluster and read back as lines."""
    path = scratch_path(spark, "export-hosts")
    context = node_context(spark, d)
    sinks.write_listing(context, path)
    return sinks.read_listing(spark, path, cluster_type=context.schema["cluster"].dataType.simpleString(),
                              position=True).withColumnRenamed("value", "line")


def export_dns(spark, d):
    """Q9: the comma-separated peer listing written per cluster and read
    back as entries."""
    path = scratch_path(spark, "export-dns")
    context = node_context(spark, d)
    sinks.write_listing(context, path, "dns_entry", sinks.DNS_SEPARATOR)
    return sinks.read_listing(spark, path, sinks.DNS_SEPARATOR,
                              context.schema["cluster"].dataType.simpleString(),
                              position=True).withColumnRenamed("value", "entry")


def report_coverage_stream(spark, d):
    """Q10s: the events table as a stream (availableNow), to the end."""
    fleet = views.fleet(spark, d)
    base = scratch_path(spark, "coverage-stream")
    q = coverage_stream.start_coverage_stream(
        fleet, views.checkins_from(table_stream(spark, d, "events")),
        base + "/state", base + "/checkpoint")
    q.awaitTermination()
    return coverage_stream.coverage_from_state(spark, fleet, base + "/state")


def unknown_checkins_stream(spark, d):
    """The second output of the check-in stream: what matches no row."""
    fleet = views.fleet(spark, d)
    base = scratch_path(spark, "unknown-stream")
    q = coverage_stream.start_coverage_stream(
        fleet, views.checkins_from(table_stream(spark, d, "events")), base + "/state", base + "/checkpoint")
    q.awaitTermination()
    return coverage_stream.unknown_from_state(spark, base + "/state")


def _latch_stream(target: bool) -> Query:
    def run(spark, d):
        fleet = views.fleet(spark, d)
        base = scratch_path(spark, "latch-stream")
        q = latch_stream.start_latch_stream(
            fleet, views.probes_from(table_stream(spark, d, "events")), target,
            base + "/state", base + "/checkpoint")
        q.awaitTermination()
        return latch_stream.latches_from_state(spark, fleet, base + "/state")
    run.__name__ = f"latch_{'on' if target else 'off'}_stream"
    return run


def _all_up_stream(fleet_of: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark, d):
        fleet = fleet_of(spark, d)
        base = scratch_path(spark, "all-up-stream")
        q = all_up_stream.start_all_up_stream(
            fleet, views.probes_from(table_stream(spark, d, "events")), base + "/state", base + "/checkpoint")
        q.awaitTermination()
        return all_up_stream.all_up_from_state(spark, fleet, base + "/state")
    return run


def queries() -> dict[str, Query]:
    return {
        "fleet_scan": fleet_scan,
        "fleet_scan_shared": fleet_scan_shared,
        "fleet_scan_json": fleet_scan_json,
        "fleet_scan_json_split": fleet_scan_json_split,
        "parse_checkins": parse_checkins,
        "parse_probes": parse_probes,
        "apply_checkins": apply_checkins,
        "apply_checkins_shared": apply_checkins_shared,
        "apply_checkins_stream": apply_checkins_stream,
        "apply_checkins_keep_ip": apply_checkins_keep_ip,
        "unknown_checkins": unknown_checkins,
        "fleet_state": fleet_state,
        "cluster_state": cluster_state,
        "power_source": power_source,
        "node_power": node_power,
        "select_all": _select("all"),
        "select_running": _select("running"),
        "select_head": _select("head"),
        "node_context": node_context,
        "running_context": running_context,
        "report_coverage": report_coverage,
        "report_coverage_wide": report_coverage_wide,
        "report_coverage_runs": report_coverage_runs,
        "report_coverage_runs_split": report_coverage_runs_split,
        "not_reported": not_reported,
        "not_reported_wide": not_reported_wide,
        "all_up_at": all_up_at,
        "all_up_at_wide": all_up_at_wide,
        "all_up_at_shared": all_up_at_shared,
        "latch_on": latch_on,
        "latch_on_wide": latch_on_wide,
        "latch_on_ties": _latch_ties(True),
        "latch_off_ties": _latch_ties(False),
        "latch_off": latch_off,
        "export_state": export_state,
        "export_hosts": export_hosts,
        "export_dns": export_dns,
        "report_coverage_stream": report_coverage_stream,
        "unknown_checkins_stream": unknown_checkins_stream,
        "all_up_at_stream": _all_up_stream(views.fleet),
        "all_up_at_wide_stream": _all_up_stream(views.fleet_wide),
        "latch_on_stream": _latch_stream(True),
        "latch_off_stream": _latch_stream(False),
    }
