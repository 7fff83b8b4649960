"""Probes landed as ping output files, one folder per node."""

import os

from rollcall.operators import convergence, parse, state
from rollcall.sources.probe_text import probe_text_stream, read_probe_texts

FLEET_SCHEMA = ("cluster int, node long, idx long, mac string, ip string, is_master boolean, "
                "is_physical boolean, nc string, vmware string, path string")
FLEET = [(1, 10, 0, "AA01", "10.1.0.0", True, True, "", None, ""),
         (1, 11, 1, "AA02", "10.1.0.1", False, True, "", None, "")]

REPLY = "\r\nPinging 10.1.0.{n} with 32 bytes of data:\r\nReply from 10.1.0.{n}: bytes=32 time<1ms TTL=64\r\n"
TIMEOUT = "\r\nPinging 10.1.0.{n} with 32 bytes of data:\r\nRequest timed out.\r\n"
PINGS = [(10, REPLY), (11, TIMEOUT), (11, REPLY), (10, TIMEOUT)]  # in landing order


def _land(folder):
    for i, (node, text) in enumerate(PINGS):
        d = os.path.join(folder, f"node={node}")
        os.makedirs(d, exist_ok=True)
        p = os.path.join(d, f"ping-{i}.txt")
        with open(p, "w", encoding="utf-8", newline="") as f:
            f.write(text.format(n=node - 10))
        t = 1_700_000_000 + i
        os.utime(p, (t, t))


def test_landed_pings_to_probes(spark, scratch):
    _land(scratch)
    pp = parse.parse_probes(read_probe_texts(spark, scratch))
    rows = sorted((r.seq, r.node, r.up) for r in pp.collect())
    base = 1_700_000_000 * 1_000_000
    assert rows == [(base, 10, True), (base + 1_000_000, 11, False),
                    (base + 2_000_000, 11, True), (base + 3_000_000, 10, False)]
    fleet = spark.createDataFrame(FLEET, FLEET_SCHEMA)
    ups = {r.idx: r.up for r in state.fleet_state(fleet, pp).collect()}
    assert ups == {0: False, 1: True}
    latch = [(r.idx, r.seq) for r in convergence.ordered_latch(fleet, pp, True).collect()]
    assert sorted(latch) == [(0, base), (1, base + 2_000_000)]


def test_landed_pings_stream(spark, scratch):
    src = os.path.join(scratch, "in")
    _land(src)
    q = (parse.parse_probes(probe_text_stream(spark, src))
         .writeStream.format("memory").queryName("landed_pings")
         .option("checkpointLocation", os.path.join(scratch, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT count(*) AS n, count_if(up) AS u FROM landed_pings").first()
    assert (got.n, got.u) == (4, 2)


def test_landed_pings_feed_the_latch_stream(spark, scratch):
    from rollcall.streaming import latch as latch_stream

    src = os.path.join(scratch, "in")
    _land(src)
    fleet = spark.createDataFrame(FLEET, FLEET_SCHEMA)
    q = latch_stream.start_latch_stream(fleet, probe_text_stream(spark, src), True,
                                        os.path.join(scratch, "state"),
                                        os.path.join(scratch, "ckpt"))
    q.awaitTermination()
    got = sorted((r.idx, r.seq) for r in latch_stream.latches_from_state(
        spark, fleet, os.path.join(scratch, "state")).collect())
    base = 1_700_000_000 * 1_000_000
    assert got == [(0, base), (1, base + 2_000_000)]
