"""Streams of landed text with many records per file: cut anywhere, read once."""

import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rollcall.operators import coverage, parse
from rollcall.sources import checkin_text, landed, probe_text, record_stream
from rollcall.streaming import coverage as cov_stream


def _text(rng, n, separator):
    return separator.join("".join(rng.choice("ab\r\né ") for _ in range(rng.randrange(9))) for _ in range(n))


@pytest.mark.parametrize("separator", ["\n\n", "\n", "--8<--"])
def test_cuts_lose_and_repeat_nothing(separator, monkeypatch):
    monkeypatch.setattr(record_stream, "_READ", 5)
    rng, sep = random.Random(len(separator)), separator.encode()
    for _ in range(150):
        raw = _text(rng, rng.randrange(12), separator).encode()
        want, at = [], 0
        for part in raw.split(sep):
            if part.strip():
                want.append((at, part))
            at += len(part) + len(sep)
        cuts = sorted(rng.randrange(len(raw) + 1) for _ in range(rng.randrange(6))) + [len(raw)]
        got = []
        for a, b in zip([0, *cuts], cuts):
            if a < b:
                got += record_stream.records(io.BytesIO(raw), len(raw), a, b, sep)
        assert got == want


def _checkin(i):
    return (f"listening on [any] 80 ...\nconnect to [10.0.0.1] from (A) [172.16.0.{i % 250}] 4{i}\n"
            f"GET /?MAC=M{i % 9} HTTP/1.1")


def _land(folder, files):
    """Files of check-ins, each later than the one before."""
    os.makedirs(folder, exist_ok=True)
    have = len(os.listdir(folder))
    for k, rows in enumerate(files):
        path = os.path.join(folder, f"f{9 - have - k}.txt")          # names do not give the order
        with open(path, "w") as f:
            f.write("\n\n".join(rows) + "\n\n" * (k % 2))
        stamp = 1_700_000_000 + 10 * (have + k)
        os.utime(path, (stamp, stamp))


def _collect(spark, stream, base, name):
    out = os.path.join(base, name)
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, name + "-ckpt")).start())
    end = time.monotonic() + 90
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert time.monotonic() < end
    return spark.read.parquet(out)


def test_stream_has_the_order_of_the_batch_reader(spark, scratch):
    src = os.path.join(scratch, "in")
    _land(src, [[_checkin(i) for i in range(a, a + 7)] for a in (0, 7, 14)])
    stream = record_stream.record_stream(spark, src, "\n\n", max_bytes_per_trigger=300)   # under half a file
    got = _collect(spark, stream, scratch, "out")
    batch = landed.read_records(spark, src, "\n\n")
    order = lambda df: [(r.value, r.ts) for r in df.orderBy("seq").collect()]
    assert [v for v, _ in order(got)] == [v for v, _ in order(batch)] == [_checkin(i) for i in range(21)]
    assert order(got) == order(batch)


def test_restart_in_the_middle_of_a_file(spark, scratch):
    src = os.path.join(scratch, "in")
    _land(src, [[_checkin(i) for i in range(12)]])
    stream = record_stream.record_stream(spark, src, "\n\n", max_bytes_per_trigger=200)
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")

    def run(until):
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).start())
        end = time.monotonic() + 60
        while time.monotonic() < end and q.isActive and not until(q):
            time.sleep(0.02)
        q.stop()

    run(lambda q: q.lastProgress is not None and q.lastProgress.batchId >= 1)
    some = spark.read.parquet(out).count()
    _land(src, [[_checkin(i) for i in range(12, 20)]])
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).start()
    q.processAllAvailable()
    q.stop()
    values = [r.value for r in spark.read.parquet(out).orderBy("seq").collect()]
    assert values == [_checkin(i) for i in range(20)]
    assert 0 < some < 20


def test_checkins_of_many_a_file_feed_the_coverage_stream(spark, scratch):
    src = os.path.join(scratch, "in")
    _land(src, [[_checkin(i) for i in range(a, a + 6)] for a in (0, 6, 12)])
    fleet = spark.createDataFrame([(i % 2, i // 2, f"m{i}", "x") for i in range(8)],
                                  "cluster long, idx long, mac string, ip string")
    stream = checkin_text.checkin_text_stream(spark, src, separator="\n\n", max_bytes_per_trigger=250)
    q = cov_stream.start_coverage_stream(fleet, stream, scratch + "/state", scratch + "/ckpt",
                                         trigger={"processingTime": "0 seconds"})
    q.processAllAvailable()
    q.stop()
    batch = parse.parse_checkins(checkin_text.read_checkin_texts(spark, src, separator="\n\n"))
    got, want = (sorted(tuple(r) for r in df.select("cluster", "n", "reported", "pending").collect())
                 for df in (cov_stream.coverage_from_state(spark, fleet, scratch + "/state"),
                            coverage.report_coverage(fleet, batch)))
    assert got == want and sum(r[2] for r in got) == 8


def test_probes_of_many_a_file_keep_their_node(spark, scratch):
    src = os.path.join(scratch, "in")
    for node in (3, 14):
        _land(os.path.join(src, f"node={node}"), [[f"Request timed out. {node} {i}" for i in range(4)]])
    got = _collect(spark, probe_text.probe_text_stream(spark, src, separator="\n\n"), scratch, "out")
    assert {(r.node, r.output) for r in got.collect()} == {
        (node, f"Request timed out. {node} {i}") for node in (3, 14) for i in range(4)}
    assert got.where(F.col("ts").isNull()).count() == 0
