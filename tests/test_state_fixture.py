"""
section 5: MAC in other case, duplicate MAC, no head node, empty string vs
null, later address wins, check-in after the cut-off ignored."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.operators import coverage, parse, state

FLEET_SCHEMA = ("cluster int, node long, idx long, mac string, ip string, is_master boolean, "
                "is_physical boolean, nc string, vmware string, path string")

FLEET = [
    # cluster 1: head is idx 1 (idx 0 is not a master)
    (1, 10, 0, "AA01", "10.1.0.0", False, True, "", None, ""),
    (1, 11, 1, "AA02", "10.1.0.1", True, None, "10.9.9.9", "/v", "/p.vmx"),
    (1, 12, 2, "AA03", "10.1.0.2", True, False, "", None, "/q.vmx"),
    # cluster 2: no head node; idx 1 repeats cluster 1's MAC (in other case)
    (2, 20, 0, "BB01", "10.2.0.0", None, None, None, None, None),
    (2, 21, 1, "aa02", "10.2.0.1", False, False, "", None, ""),
]


def _checkin(seq, ip, mac):
    host = "(UNKNOWN)" if ip else "(a.b)"
    connect = f"connect to [10.0.0.1] from {host} [{ip or '9.9.9.9'}] 4000"
    request = f"GET /?MAC={mac} HTTP/1.1" if mac else "POST / HTTP/1.1"
    return (seq, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq), connect, request)


CHECKINS = [
    _checkin(1, "172.16.0.1", "aa01"),   # cluster 1 idx 0, lower case
    _checkin(2, "172.16.0.2", "AA02"),   # cluster 1 idx 1
    _checkin(3, "172.16.0.3", "AA01"),   # later address for idx 0
    _checkin(4, None, "AA03"),           # idx 2 reports without an address -> cut-off 4
    _checkin(5, "172.16.0.5", "AA01"),   # after cluster 1's cut-off: not consumed
    _checkin(6, "172.16.0.6", "BB01"),   # cluster 2 idx 0
    _checkin(7, "172.16.0.7", "CC99"),   # unknown MAC
    _checkin(8, "172.16.0.8", None),     # malformed request
]


@pytest.fixture()
def fleet(spark):
    return spark.createDataFrame(FLEET, FLEET_SCHEMA)


@pytest.fixture()
def parsed(spark):
    df = spark.createDataFrame(CHECKINS, "seq long, ts timestamp, connect_line string, "
                                         "request_line string")
    return parse.parse_checkins(df)


def test_coverage_and_cutoff(fleet, parsed):
    got = {r.cluster: tuple(r)[1:] for r in coverage.report_coverage(fleet, parsed).collect()}
    # cluster 2's idx 1 shares cluster 1's MAC: never reported, never complete
    assert got == {1: (3, 3, 0, 4), 2: (2, 1, 1, None)}
    missing = [(r.cluster, r.idx) for r in coverage.not_reported(fleet, parsed).collect()]
    assert missing == [(2, 1)]


def test_apply_checkins_last_address_before_cutoff(fleet, parsed):
    got = {(r.cluster, r.idx): (r.ip, r.reported, r.n_checkins)
           for r in state.apply_checkins(fleet, parsed).collect()}
    assert got == {
        (1, 0): ("172.16.0.3", True, 2),   # seq 5 is after the cut-off
        (1, 1): ("172.16.0.2", True, 1),
        (1, 2): ("10.1.0.2", True, 1),     # reported, but no address to take
        (2, 0): ("172.16.0.6", True, 1),
        (2, 1): ("10.2.0.1", False, 0),
    }
    kept = {(r.cluster, r.idx): r.ip for r in state.apply_checkins(fleet, parsed, update=False)
            .collect()}
    assert kept[(1, 0)] == "10.1.0.0"


def test_unknown_checkins(fleet, parsed):
    got = sorted((r.seq, r.reason) for r in state.unknown_checkins(fleet, parsed).collect())
    assert got == [(4, "no_ip"), (7, "unknown_mac"), (8, "no_mac")]


def test_heads_roles_and_selection(spark, fleet):
    heads = {r.cluster: (r.head_idx, r.head_ip) for r in state.head_nodes(fleet).collect()}
    assert heads == {1: (1, "10.1.0.1"), 2: (None, None)}
    ctx = {(r.cluster, r.idx): (r.role, r.head_idx) for r in state.node_context(fleet).collect()}
    assert ctx[(1, 2)] == ("master", 1) and ctx[(2, 0)] == ("slave", None)

    probes = spark.createDataFrame(
        [(1, 10, "Reply from 1.1.1.1: bytes=32 time=1ms TTL=64"),
         (2, 10, "Request timed out."),            # latest for node 10: down
         (3, 11, "Reply from 1.1.1.1: bytes=32 time<1ms TTL=64"),
         (4, 20, "Reply from 1.1.1.1: bytes=32 time=2ms TTL=64")],
        "seq long, node long, output string").withColumn("ts", F.current_timestamp())
    pp = parse.parse_probes(probes)
    st = state.fleet_state(fleet, pp)
    lines = {(r.cluster, r.idx): r.line for r in st.collect()}
    assert lines[(1, 0)] == "off slave  0 3 AA01 10.1.0.0"
    assert lines[(1, 1)] == "on  master 1 3 AA02 10.1.0.1"
    cs = {r.cluster: (r.n, r.n_up, r.all_up) for r in state.cluster_state(st).collect()}
    assert cs == {1: (3, 1, False), 2: (2, 1, False)}
    hd = state.head_nodes(fleet)
    sel = {m: sorted((r.cluster, r.idx) for r in state.select_nodes(st, m, hd).collect())
           for m in state.SELECT_MODES}
    assert sel["all"] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert sel["running"] == [(1, 1), (2, 0)]
    assert sel["head"] == [(1, 1)]


def test_power_source_counts(fleet):
    got = {(r.cluster, r.source): r.n for r in state.power_source(fleet).collect()}
    assert got == {(1, "wol"): 1, (1, "remote"): 1, (1, "local"): 1, (2, None): 2}


def test_apply_checkins_chains_into_node_context(fleet, parsed):
    patched = state.apply_checkins(fleet, parsed)
    assert patched.columns[:len(FLEET_SCHEMA.split(","))] == [
        c.split()[0] for c in FLEET_SCHEMA.split(", ")]
    ctx = {(r.cluster, r.idx): r.dns_entry for r in state.node_context(patched).collect()}
    assert ctx[(1, 0)] == "172.16.0.3-node0"
