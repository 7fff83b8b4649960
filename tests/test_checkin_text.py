"""Check-ins landed as listener text files, batch and stream."""

import os

from rollcall.operators import parse, state
from rollcall.sources.checkin_text import checkin_text_stream, read_checkin_texts

FLEET_SCHEMA = ("cluster int, node long, idx long, mac string, ip string, is_master boolean, "
                "is_physical boolean, nc string, vmware string, path string")
FLEET = [(1, 10, 0, "AA01", "10.1.0.0", True, True, "", None, ""),
         (1, 11, 1, "AA02", "10.1.0.1", False, True, "", None, "")]

RUNS = [  # invented addresses
    "listening on [any] 3 ...\nconnect to [10.0.0.1] from (UNKNOWN) [172.16.0.5] 50123\n"
    "GET /?MAC=aa01 HTTP/1.1\n",
    "listening on [any] 3 ...\r\nconnect to [10.0.0.1] from (UNKNOWN) [172.16.0.6] 50124\r\n"
    "GET /?MAC=AA02 HTTP/1.1\r\n",
    "listening on [any] 3 ...\nconnect to [10.0.0.1] from (UNKNOWN) [172.16.0.7] 50125\n"
    "GET /?MAC=AA01 HTTP/1.1\n",
    "listening on [any] 3 ...\nconnect to [10.0.0.1] from (host.lan) [172.16.0.8] 50126\n"
    "POST / HTTP/1.1\n",
]


def _land(folder):
    os.makedirs(folder, exist_ok=True)
    for i, text in enumerate(RUNS):
        with open(os.path.join(folder, f"run-{i}.txt"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
        t = 1_700_000_000 + i  # landing order
        os.utime(os.path.join(folder, f"run-{i}.txt"), (t, t))


def test_landed_text_to_checkins(spark, scratch):
    _land(scratch)
    rows = sorted(tuple(r) for r in parse.parse_checkins(read_checkin_texts(spark, scratch))
                  .select("seq", "ip", "mac", "malformed").collect())
    base = 1_700_000_000 * 1_000_000
    assert rows == [(base, "172.16.0.5", "aa01", False),
                    (base + 1_000_000, "172.16.0.6", "AA02", False),
                    (base + 2_000_000, "172.16.0.7", "AA01", False),
                    (base + 3_000_000, None, None, True)]
    fleet = spark.createDataFrame(FLEET, FLEET_SCHEMA)
    pc = parse.parse_checkins(read_checkin_texts(spark, scratch))
    got = {r.idx: (r.ip, r.n_checkins) for r in state.apply_checkins(fleet, pc).collect()}
    # cut-off is the first check-in of idx 1: idx 0's second check-in comes after it
    assert got == {0: ("172.16.0.5", 1), 1: ("172.16.0.6", 1)}


def test_landed_text_stream(spark, scratch):
    src = os.path.join(scratch, "in")
    _land(src)
    q = (checkin_text_stream(spark, src, max_files_per_trigger=1)
         .writeStream.format("memory").queryName("landed_checkins")
         .option("checkpointLocation", os.path.join(scratch, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT count(*) AS n, count(DISTINCT seq) AS s FROM landed_checkins").first()
    assert (got.n, got.s) == (4, 4)


def test_landed_text_feeds_the_coverage_stream(spark, scratch):
    from rollcall.streaming import coverage as cov_stream

    src = os.path.join(scratch, "in")
    _land(src)
    fleet = spark.createDataFrame(FLEET, FLEET_SCHEMA)
    state_path = os.path.join(scratch, "state")
    cov_stream.start_coverage_stream(fleet, checkin_text_stream(spark, src), state_path,
                                     os.path.join(scratch, "ckpt")).awaitTermination()
    got = [tuple(r) for r in cov_stream.coverage_from_state(spark, fleet, state_path).collect()]
    base = 1_700_000_000 * 1_000_000
    assert got == [(1, 2, 2, 0, base + 1_000_000)]


def test_many_runs_per_file_in_a_total_order(spark, scratch):
    """Blank lines end a run; ties of the file time go by path, then place."""
    import os

    from rollcall.operators.parse import parse_checkins
    from rollcall.sources.checkin_text import read_checkin_texts

    def run(i):
        return (f"listening on [any] 80 ...\nconnect to [10.0.0.1] from (UNKNOWN) [10.0.0.{i}] 49152\n"
                f"GET /?MAC=M{i} HTTP/1.1\n\n")
    for name, ids in (("b.log", range(20, 24)), ("a.log", range(0, 20)), ("c.log", range(30, 33))):
        path = os.path.join(scratch, name)
        with open(path, "w", encoding="utf-8") as f:
            f.write("".join(run(i) for i in ids))
        os.utime(path, (1_700_000_000 + (5 if name == "c.log" else 0),) * 2)
    rows = parse_checkins(read_checkin_texts(spark, scratch, separator="\n\n")).orderBy("seq").collect()
    order = [*range(0, 24), *range(30, 33)]
    assert [(r.seq, r.ip, r.mac) for r in rows] == [
        (k, f"10.0.0.{i}", f"M{i}") for k, i in enumerate(order)]
