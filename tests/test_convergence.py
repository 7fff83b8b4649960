"""Q11 and Q12 against a plain Python walk of the reference's loops, on small
hand-made and random logs, with both scan paths."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rollcall.operators.convergence import all_up_at, ordered_latch

FLEET_SCHEMA = ("cluster int, node long, idx long, mac string, ip string, is_master boolean, "
                "is_physical boolean, nc string, vmware string, path string")
PROBE_SCHEMA = "seq long, ts timestamp, node long, up boolean"


def _fleet(spark, sizes):
    rows, node = [], 0
    for c, n in sizes.items():
        for i in range(n):
            rows.append((c, node, i, f"M{node}", f"ip{node}", i == 0, None, "", None, ""))
            node += 1
    return spark.createDataFrame(rows, FLEET_SCHEMA), rows


def _probes(spark, events):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(seconds=s), node, up) for s, node, up in events]
    return spark.createDataFrame(rows, PROBE_SCHEMA)


def walk_latch(fleet_rows, events, target):
    """Ordered wait, one cluster at a time: wait for node 0, then node 1..."""
    out = []
    idx_of = {r[1]: (r[0], r[2]) for r in fleet_rows}
    clusters = {}
    for r in fleet_rows:
        clusters.setdefault(r[0], 0)
        clusters[r[0]] += 1
    pointer = {c: 0 for c in clusters}
    for seq, node, up in sorted(events):
        if node not in idx_of or up != target:
            continue
        c, i = idx_of[node]
        if pointer[c] == i and i < clusters[c]:
            out.append((c, i, node, seq))
            pointer[c] += 1
    return sorted(out)


def walk_all_up(fleet_rows, events):
    idx_of = {r[1]: r[0] for r in fleet_rows}
    sizes = {}
    for r in fleet_rows:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    state, first = {}, {}
    for seq, node, up in sorted(events):
        if node not in idx_of:
            continue
        c = idx_of[node]
        state[node] = up
        if c not in first and sum(1 for nd, u in state.items() if u and idx_of[nd] == c) == sizes[c]:
            first[c] = seq
    return {c: first.get(c) for c in sizes}


def walk_latch_ties(fleet_rows, events, target):
    """The wait when probes share a seq and nodes stand on several rows: per
    cluster, the first event of the next row at a later seq."""
    seqs = {}
    for seq, node, up in events:
        if up == target:
            seqs.setdefault(node, set()).add(seq)
    out = []
    for c in {r[0] for r in fleet_rows}:
        last = None
        for r in sorted((r for r in fleet_rows if r[0] == c), key=lambda r: r[2]):
            later = [s for s in seqs.get(r[1], ()) if last is None or s > last]
            if not later:
                break
            last = min(later)
            out.append((c, r[2], r[1], last))
    return sorted(out)


def walk_all_up_ties(fleet_rows, events):
    """All-up with ties: changes at one moment in row order, down before up
    within a row."""
    rows = {}
    for r in fleet_rows:
        rows.setdefault(r[1], []).append((r[0], r[2]))
    steps = sorted((seq, c, i, up) for seq, node, up in events for c, i in rows.get(node, ()))
    sizes, state, first = {}, {}, {}
    for r in fleet_rows:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    for seq, c, i, up in steps:
        changed = state.get((c, i), False) != up
        state[(c, i)] = up
        if changed and c not in first and sum(
                u for (d, _), u in state.items() if d == c) == sizes[c]:
            first[c] = seq
    return {c: first.get(c) for c in sizes}


def _random_log(seed, sizes, n_events, p_up=0.8, unknown_nodes=3):
    rnd = random.Random(seed)
    total = sum(sizes.values())
    events = []
    for s in range(n_events):
        node = rnd.randrange(total + unknown_nodes)
        events.append((s, node, rnd.random() < p_up))
    return events


def test_latch_node_goes_down_after_latch(spark):
    # cluster 0: nodes 0,1,2. node 0 up, node 1 up, node 0 down, node 2 up.
    fleet, rows = _fleet(spark, {0: 3})
    events = [(1, 0, True), (2, 1, True), (3, 0, False), (4, 2, True)]
    probes = _probes(spark, events)
    got = sorted(tuple(r) for r in ordered_latch(fleet, probes, True).collect())
    assert got == [(0, 0, 0, 1), (0, 1, 1, 2), (0, 2, 2, 4)]
    # ...but the cluster was never all up at once
    res = {r.cluster: r.all_up_seq for r in all_up_at(fleet, probes).collect()}
    assert res == {0: None}


def test_latch_one_step_per_event_and_stall(spark):
    fleet, rows = _fleet(spark, {5: 4})
    # node 1's event before node 0 latches does not count; node 2 never up
    events = [(1, 1, True), (2, 0, True), (3, 1, True), (4, 3, True), (5, 2, False)]
    got = sorted(tuple(r) for r in ordered_latch(fleet, _probes(spark, events), True).collect())
    assert got == [(5, 0, 0, 2), (5, 1, 1, 3)]
    got_off = sorted(tuple(r) for r in ordered_latch(fleet, _probes(spark, events), False).collect())
    assert got_off == []  # node 0 is never seen down


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("split", [False, True])
def test_latch_and_all_up_match_walk(spark, seed, split):
    sizes = {0: 1, 1: 7, 2: 3, 3: 12}
    fleet, rows = _fleet(spark, sizes)
    events = _random_log(seed, sizes, 900, p_up=0.85)
    probes = _probes(spark, events)
    kw = {"split": split, "num_chunks": 5} if split else {"split": False}
    for target in (True, False):
        got = sorted(tuple(r) for r in ordered_latch(fleet, probes, target, **kw).collect())
        assert got == walk_latch(rows, events, target)
    res = {r.cluster: r.all_up_seq for r in all_up_at(fleet, probes, **kw).collect()}
    assert res == walk_all_up(rows, events)


def test_latch_hot_cluster(spark):
    # one cluster holds nearly all events; chunked scans split it
    sizes = {0: 33, 1: 2}
    fleet, rows = _fleet(spark, sizes)
    rnd = random.Random(11)
    events = [(s, rnd.randrange(33) if rnd.random() < 0.95 else 33 + rnd.randrange(2),
               rnd.random() < 0.9) for s in range(4000)]
    probes = _probes(spark, events)
    got = sorted(tuple(r) for r in ordered_latch(fleet, probes, True, split=True, num_chunks=12)
                 .collect())
    assert got == walk_latch(rows, events, True)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(sizes=st.lists(st.integers(1, 6), min_size=1, max_size=3),
       log=st.lists(st.tuples(st.integers(0, 20), st.booleans()), max_size=60))
def test_latch_and_all_up_property(spark, sizes, log):
    sizes = dict(enumerate(sizes))
    fleet, rows = _fleet(spark, sizes)
    events = [(s, node, up) for s, (node, up) in enumerate(log)]
    probes = _probes(spark, events) if events else spark.createDataFrame([], PROBE_SCHEMA)
    for target in (True, False):
        got = sorted(tuple(r) for r in ordered_latch(fleet, probes, target).collect())
        assert got == walk_latch(rows, events, target)
    res = {r.cluster: r.all_up_seq for r in all_up_at(fleet, probes).collect()}
    assert res == walk_all_up(rows, events)


def test_hot_cluster_on_driver_tables(spark):
    """A third of the suppliers in one cluster: both scan paths agree."""
    from pyspark.sql import functions as F

    from conftest import SF_MID
    from rollcall.operators.parse import parse_probes
    from rollcall.sources import views
    from rollcall.sources.tables import read_table

    sup = read_table(spark, SF_MID, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    hot = sup.withColumn("s_nationkey", F.when(F.col("s_suppkey") < 33, F.lit(99))
                         .otherwise(F.col("s_nationkey")))
    fleet = views.fleet_from(hot, "s_nationkey", "s_suppkey", "s_acctbal")
    pp = parse_probes(views.probes(spark, SF_MID))
    assert fleet.where("cluster = 99").count() == 33
    out = {}
    for kw in ({"split": False}, {"split": True, "num_chunks": 12}):
        out[kw["split"]] = (sorted(map(tuple, all_up_at(fleet, pp, **kw).collect())),
                            sorted(map(tuple, ordered_latch(fleet, pp, True, **kw).collect())))
    assert out[False] == out[True]
    assert any(r[0] == 99 for r in out[True][1])


def test_latch_two_probes_at_one_seq(spark):
    fleet, _ = _fleet(spark, {0: 3})
    events = [(10, 0, True), (20, 1, True), (10, 1, True), (15, 2, True), (50, 2, True)]
    for kw in ({"split": False}, {"split": True, "num_chunks": 4}):
        got = sorted(tuple(r) for r in ordered_latch(fleet, _probes(spark, events), True, **kw).collect())
        assert got == [(0, 0, 0, 10), (0, 1, 1, 20), (0, 2, 2, 50)]


def test_latch_rounds_of_one_seq_each(spark):
    fleet, _ = _fleet(spark, {4: 3})
    events = [(rnd, node, True) for rnd in (1, 2, 3) for node in range(3)] * 2
    got = sorted(tuple(r) for r in ordered_latch(fleet, _probes(spark, events), True).collect())
    assert got == [(4, 0, 0, 1), (4, 1, 1, 2), (4, 2, 2, 3)]


@pytest.mark.parametrize("seed", [5, 6])
def test_tied_logs_and_shared_nodes_match_walk_on_both_paths(spark, seed):
    rnd = random.Random(seed)
    rows, node = [], 0
    for c, n in {0: 1, 1: 9, 2: 4, 3: 6}.items():
        for i in range(n):
            rows.append((c, rnd.randrange(12), i, f"M{c}-{i}", f"ip{c}-{i}", i == 0, None, "", None, ""))
    fleet = spark.createDataFrame(rows, FLEET_SCHEMA)
    events = [(rnd.randrange(150), rnd.randrange(14), rnd.random() < 0.8) for _ in range(900)]
    probes = _probes(spark, events)
    for kw in ({"split": False}, {"split": True, "num_chunks": 6}):
        for target in (True, False):
            got = sorted(tuple(r) for r in ordered_latch(fleet, probes, target, **kw).collect())
            assert got == walk_latch_ties(rows, events, target)
        res = {r.cluster: r.all_up_seq for r in all_up_at(fleet, probes, **kw).collect()}
        assert res == walk_all_up_ties(rows, events)


def test_all_up_with_node_ids_made_from_shared_macs(spark):
    """The README's recipe: a duplicate MAC gives one node id on two rows; ids
    made from the MAC and the position tell the rows apart."""
    from pyspark.sql import functions as F
    rows = [(1, 7, 0, "m", "a", True, None, "", None, ""), (2, 7, 0, "M", "b", True, None, "", None, "")]
    fleet = spark.createDataFrame(rows, FLEET_SCHEMA)
    got = {r.cluster: r.all_up_seq for r in
           all_up_at(fleet, _probes(spark, [(1, 7, True)])).collect()}
    assert got == {1: 1, 2: 1}
    named = fleet.withColumn("node", F.xxhash64("cluster", "idx", F.upper("mac")))
    assert named.select("node").distinct().count() == 2


def test_jump_tables_halve(spark):
    """Level r holds only offsets that are multiples of 2^r."""
    from rollcall.operators.convergence import _jumps, wait_events
    from pyspark.sql import functions as F
    fleet, rows = _fleet(spark, {0: 32})
    probes = _probes(spark, _random_log(3, {0: 32}, 3000, p_up=0.9, unknown_nodes=0))
    starts = spark.createDataFrame([(0, 0, None)], "cluster int, start_idx long, after_seq long")
    events = wait_events(fleet, probes, True, starts)
    sizes = []
    for r, jump in enumerate(_jumps(events, 32)):
        assert jump.where(F.col("off") % (1 << r) != 0).isEmpty()
        sizes.append(jump.count())
    assert len(sizes) == 5 and sum(sizes) <= 2.1 * events.count()
