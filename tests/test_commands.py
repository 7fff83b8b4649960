"""The command-name mapping runs every command on the sf0.001 tables."""

import pytest

from conftest import SF_SMALL
from rollcall.plans.commands import COMMANDS, run_command
from rollcall.sources import views


@pytest.fixture(scope="module")
def inputs(spark):
    return views.fleet(spark, SF_SMALL), views.probes(spark, SF_SMALL), views.checkins(spark, SF_SMALL)


def test_every_command(inputs):
    """Each command's columns, and its rows against the inventory's."""
    from rollcall.operators import parse, state
    fleet, probes, checkins = inputs
    n = fleet.count()
    up = state.node_up(fleet, parse.parse_probes(probes)).where("up").count()
    heads = state.head_nodes(fleet).where("head_idx IS NOT NULL").count()
    clusters = fleet.select("cluster").distinct().count()
    rows = {"state": n, "readAReport": checkins.count(), "readReport": n, "readReportKeepIp": n,
            "coverage": clusters, "hosts": n, "waitOn": 10, "waitOff": 10, "allUp": clusters, "on": n}
    rows |= dict.fromkeys(["off", "reboot", "eraseAll", "deployK8S", "startK8S", "stopK8S"], up)
    rows |= dict.fromkeys(["base", "deploy1", "deploy2", "deployConfig"], n)
    assert len(COMMANDS) == 28 and up < n
    for name in COMMANDS:
        df = run_command(name, fleet, probes=probes, checkins=checkins)
        assert df.count() == rows.get(name, heads), name
        if name in ("deployK8S", "startK8S", "stopK8S", "base", "init"):
            assert {"role", "head_idx", "head_ip", "dns_entry", "hosts_entry"} <= set(df.columns)


def test_head_commands_select_only_heads(inputs):
    fleet, probes, checkins = inputs
    heads = run_command("init", fleet)
    assert all(r.role == "master" and r.idx == r.head_idx for r in heads.collect())


def test_unknown_command(inputs):
    with pytest.raises(KeyError):
        run_command("addRoute", inputs[0])
    assert "waitOff" in COMMANDS
