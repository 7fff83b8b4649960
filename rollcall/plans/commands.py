"""The reference's command names, mapped to the job that answers their data
half. Every command takes the inventory and, where it needs them, the raw
probes (seq, ts, node, output) and raw check-ins (seq, ts, connect_line,
request_line), and returns a DataFrame. The remote action a command ends in
(SSH, power, erase) is not built; its node selection is what is returned.

    from rollcall.plans.commands import run_command
    run_command("waitOn", fleet, probes=probes)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rollcall.operators import convergence, coverage, parse, state

Command = Callable[..., DataFrame]


def _state(fleet, probes=None, checkins=None):
    return state.fleet_state(fleet, parse.parse_probes(probes))


def _running(fleet, probes=None, checkins=None):
    return state.select_nodes(state.node_up(fleet, parse.parse_probes(probes)), "running")


def _running_context(fleet, probes=None, checkins=None):
    return state.running_context(fleet, parse.parse_probes(probes))


def _all(fleet, probes=None, checkins=None):
    return state.node_context(fleet)


def _head(fleet, probes=None, checkins=None):
    heads = state.head_nodes(fleet).where("head_idx IS NOT NULL").withColumnRenamed(
        "head_idx", "idx")
    return state.node_context(fleet).join(heads.select("cluster", "idx"), ["cluster", "idx"])


def _wait(target: bool) -> Command:
    def run(fleet, probes=None, checkins=None):
        return convergence.ordered_latch(fleet, parse.parse_probes(probes), target)
    return run


def _read_report(update: bool) -> Command:
    def run(fleet, probes=None, checkins=None):
        return state.apply_checkins(fleet, parse.parse_checkins(checkins), update)
    return run


COMMANDS: dict[str, Command] = {
    # reports
    "state": _state,
    "readAReport": lambda fleet, probes=None, checkins=None: parse.parse_checkins(checkins),
    "readReport": _read_report(True),
    "readReportKeepIp": _read_report(False),
    "coverage": lambda fleet, probes=None, checkins=None: coverage.report_coverage(
        fleet, parse.parse_checkins(checkins)),
    "hosts": lambda fleet, probes=None, checkins=None: state.node_context(fleet).select(
        "cluster", "idx", "hosts_entry"),
    # waits
    "waitOn": _wait(True),
    "waitOff": _wait(False),
    "allUp": lambda fleet, probes=None, checkins=None: convergence.all_up_at(
        fleet, parse.parse_probes(probes)),
    # actions on running nodes only
    "off": _running, "reboot": _running, "eraseAll": _running,
    "deployK8S": _running_context, "startK8S": _running_context, "stopK8S": _running_context,
    # actions on every node: how each is powered on, or its context
    "on": lambda fleet, probes=None, checkins=None: state.node_power(fleet),
    "base": _all, "deploy1": _all, "deploy2": _all, "deployConfig": _all,
    # actions on the head node only
    "init": _head, "startHadoop": _head, "stopHadoop": _head, "rebootHadoop": _head,
    "testHadoop": _head, "initK8S": _head, "tutorial": _head, "abc": _head,
}


def run_command(name: str, fleet: DataFrame, probes: DataFrame | None = None,
                checkins: DataFrame | None = None) -> DataFrame:
    if name not in COMMANDS:
        raise KeyError(f"unknown command {name!r}; known: {sorted(COMMANDS)}")
    return COMMANDS[name](fleet, probes=probes, checkins=checkins)
