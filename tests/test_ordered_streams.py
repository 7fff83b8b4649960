"""Streams whose answer depends on order: the all-up wait, the reorder buffer in
front of the ordered waits, and what a batch of the state log writes."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rollcall.operators import convergence, coverage, parse, state
from rollcall.sources.streams import parquet_stream
from rollcall.streaming import all_up, statelog
from rollcall.streaming import coverage as cov_stream
from rollcall.streaming import latch as latch_stream

UP, DOWN = "Reply from 10.0.0.1: bytes=32 time<1ms TTL=64", "Request timed out."
START = dt.datetime(2024, 3, 31, 0, 30)
PROBES = "seq long, ts timestamp, node long, output string"


def _fleet(spark, clusters, size, shared=1, text=False):
    rows = [((f"c{c}" if text else c), i, (c * size + i) // shared) for c in range(clusters) for i in range(size)]
    return spark.createDataFrame(rows, f"cluster {'string' if text else 'long'}, idx long, node long")


def _log(count, nodes, seed, up=0.8, coarse=1):
    rng = random.Random(seed)
    return [(s // coarse, START + dt.timedelta(seconds=7 * (s // coarse)), rng.randrange(nodes),
             UP if rng.random() < up else DOWN) for s in range(count)]


def _land(spark, folder, rows, cuts, schema=PROBES):
    """One file per piece, in the order given."""
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _all_up(spark, folder, fleet, base, **kw):
    stream = parquet_stream(spark, folder, max_files_per_trigger=1)
    all_up.start_all_up_stream(fleet, stream, base + "/state", base + "/ckpt", **kw).awaitTermination()
    return all_up.all_up_from_state(spark, fleet, base + "/state")


@pytest.mark.parametrize("shared,text,coarse,split", [(1, False, 1, False), (2, True, 1, False),
                                                     (3, False, 5, False), (1, False, 1, True)])
def test_all_up_stream_equals_batch_with_a_restart(spark, scratch, shared, text, coarse, split):
    fleet = _fleet(spark, 4, 4, shared, text)
    rows = _log(150, 16 // shared + 1, seed=shared, coarse=coarse)
    src, kw = os.path.join(scratch, "in"), ({"split": True, "num_chunks": 3} if split else {})
    _land(spark, src, rows, [0, 40, 75, 110])          # simultaneous probes stay in one file
    early = _rows(_all_up(spark, src, fleet, scratch, **kw))
    _land(spark, src, rows, [110, 150])
    got = _rows(_all_up(spark, src, fleet, scratch, **kw))
    probes = parse.parse_probes(spark.createDataFrame(rows, PROBES))
    assert got == _rows(convergence.all_up_at(fleet, probes))
    assert any(r[2] is not None for r in got)
    assert {r for r in early if r[2] is not None} <= set(got)


def test_all_up_replayed_batch(spark, scratch):
    fleet, rows = _fleet(spark, 3, 3), _log(90, 9, seed=5)
    src = os.path.join(scratch, "in")
    _land(spark, src, rows, [0, 30, 60, 90])
    before = _rows(_all_up(spark, src, fleet, scratch))
    ckpt = os.path.join(scratch, "ckpt", "commits")
    last = max(int(n) for n in os.listdir(ckpt) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(ckpt, name)):
            os.remove(os.path.join(ckpt, name))
    assert _rows(_all_up(spark, src, fleet, scratch)) == before


def _shuffled(rows, reach, seed):
    """Rows delivered late by up to ``reach`` places."""
    rng = random.Random(seed)
    return [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.random() * reach)]


@pytest.mark.parametrize("kind", ["latch", "all_up"])
def test_disorder_within_the_delay_gives_the_batch_answer(spark, scratch, kind):
    fleet, rows = _fleet(spark, 3, 4), _log(200, 12, seed=8)
    src, base = os.path.join(scratch, "in"), scratch
    _land(spark, src, _shuffled(rows, 20, 1), [0, 50, 90, 130, 200])
    probes = parse.parse_probes(spark.createDataFrame(rows, PROBES))
    delay = "150 seconds"                               # 7 seconds a place
    if kind == "all_up":
        _all_up(spark, src, fleet, base, delay=delay)
        buffer = all_up.reorder_buffer(spark, base + "/state")
        got = all_up.all_up_from_state(spark, fleet, base + "/state", held=buffer.held())
        want = convergence.all_up_at(fleet, probes)
    else:
        stream = parquet_stream(spark, src, max_files_per_trigger=1)
        latch_stream.start_latch_stream(fleet, stream, True, base + "/state", base + "/ckpt",
                                        delay=delay).awaitTermination()
        buffer = latch_stream.reorder_buffer(spark, base + "/state")
        got = latch_stream.latches_from_state(spark, fleet, base + "/state", held=buffer.held())
        want = convergence.ordered_latch(fleet, probes, True)
    assert _rows(got) == _rows(want)
    assert buffer.late() is None
    held = buffer.held()
    assert 0 < held.count() < 60                        # what the delay holds, not the log


def test_later_rows_are_listed_not_lost(spark, scratch):
    fleet, rows = _fleet(spark, 3, 4), _log(200, 12, seed=9)
    late = rows[10:14]
    order = rows[:10] + rows[14:120] + late + rows[120:]
    src = os.path.join(scratch, "in")
    _land(spark, src, order, [0, 60, 119, 200])
    stream = parquet_stream(spark, src, max_files_per_trigger=1)
    latch_stream.start_latch_stream(fleet, stream, True, scratch + "/state", scratch + "/ckpt",
                                    delay="60 seconds").awaitTermination()
    buffer = latch_stream.reorder_buffer(spark, scratch + "/state")
    assert sorted(r.seq for r in buffer.late().collect()) == [r[0] for r in late]
    on_time = parse.parse_probes(spark.createDataFrame(rows[:10] + rows[14:], PROBES))
    got = latch_stream.latches_from_state(spark, fleet, scratch + "/state", held=buffer.held())
    assert _rows(got) == _rows(convergence.ordered_latch(fleet, on_time, True))


def _checkins(count, nodes, seed):
    rng = random.Random(seed)
    return [(s, START + dt.timedelta(seconds=7 * s), f"connect to [10.0.0.1] from (A) [172.16.0.{s % 250}] 4",
             f"GET /?MAC=M{rng.randrange(nodes)} HTTP/1.1" if s % 11 else "POST / HTTP/1.1") for s in range(count)]


CHECKINS = "seq long, ts timestamp, connect_line string, request_line string"


def test_coverage_in_disorder_within_the_delay(spark, scratch):
    """The address patch depends on order; unknown reporters come out of the
    same micro-batches."""
    fleet = _fleet(spark, 2, 4).withColumn("mac", F.concat(F.lit("m"), "node")).withColumn("ip", F.lit("x"))
    rows = _checkins(120, 10, seed=2)
    src, at = os.path.join(scratch, "in"), scratch + "/state"
    _land(spark, src, _shuffled(rows, 15, 3), [0, 30, 70, 120], CHECKINS)
    stream = parquet_stream(spark, src, max_files_per_trigger=1)
    cov_stream.start_coverage_stream(fleet, stream, at, scratch + "/ckpt", delay="2 minutes").awaitTermination()
    buffer = cov_stream.reorder_buffer(spark, at)
    assert buffer.late() is None
    released = parse.parse_checkins(spark.createDataFrame(rows, CHECKINS)).join(
        buffer.held().select("seq"), "seq", "left_anti")
    assert 80 < released.count() < 120
    assert _rows(cov_stream.coverage_from_state(spark, fleet, at)) == _rows(coverage.report_coverage(fleet, released))
    assert _rows(cov_stream.inventory_from_state(spark, fleet, at)) == _rows(state.apply_checkins(fleet, released))
    cols = ["seq", "ts", "ip", "mac", "reason"]
    assert _rows(cov_stream.unknown_from_state(spark, at).select(cols)) == _rows(
        state.unknown_checkins(fleet, released).select(cols))


def test_replayed_batch_adds_no_unknown_reporters(spark, scratch):
    fleet = _fleet(spark, 1, 3).withColumn("mac", F.concat(F.lit("M"), "node"))
    src, at = os.path.join(scratch, "in"), scratch + "/state"
    _land(spark, src, _checkins(60, 6, seed=4), [0, 30, 60], CHECKINS)

    def run():
        stream = parquet_stream(spark, src, max_files_per_trigger=1)
        cov_stream.start_coverage_stream(fleet, stream, at, scratch + "/ckpt").awaitTermination()
        return _rows(cov_stream.unknown_from_state(spark, at))

    before = run()
    for name in ("1", ".1.crc"):
        path = os.path.join(scratch, "ckpt", "commits", name)
        if os.path.exists(path):
            os.remove(path)
    assert run() == before and len(before) > 5


def test_wait_ends_on_timeout_and_with_the_query(spark, scratch, monkeypatch):
    fleet = _fleet(spark, 1, 9).withColumn("mac", F.concat(F.lit("M"), "node"))
    src, at = os.path.join(scratch, "in"), scratch + "/state"
    _land(spark, src, _checkins(20, 3, seed=4), [0, 20], CHECKINS)   # six rows never report
    reads = []
    read = statelog.StateLog.read
    monkeypatch.setattr(statelog.StateLog, "read", lambda self, *a: (reads.append(a), read(self, *a))[1])
    stream = parquet_stream(spark, src, max_files_per_trigger=1)
    q = cov_stream.start_coverage_stream(fleet, stream, at, scratch + "/ckpt", trigger={"processingTime": "0 seconds"})
    q.processAllAvailable()
    reads.clear()
    (row,) = cov_stream.await_full_coverage(spark, q, fleet, at, timeout_seconds=2).collect()
    assert q.isActive and row.pending == 6 and len(reads) == 1       # the final answer only
    q.stop()
    (row,) = cov_stream.await_full_coverage(spark, q, fleet, at, timeout_seconds=60).collect()
    assert row.pending == 6


# -- the state log -----------------------------------------------------------------

SCHEMA = StructType([StructField("k", LongType()), StructField("v", StringType())])


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_state_log_keeps_the_newest_row_of_a_key(spark, scratch):
    log = statelog.StateLog(spark, scratch + "/log", SCHEMA, ["k"])
    rng, want, history = random.Random(1), {}, {}
    assert log.read().collect() == []
    for b in [0, 1, 2, 4, 5, 6, 7, 9]:                  # batches without changes write nothing
        changed = {rng.randrange(20): f"{b}" for _ in range(4)}
        for _ in range(2 if b % 3 == 0 else 1):         # some are replayed
            assert dict(log.read(b).collect()) == history.get(b, want)
            log.write(spark.createDataFrame(list(changed.items()), SCHEMA), b)
        want = {**want, **changed}
        assert dict(log.read().collect()) == want
        assert len(log.current()) <= 4


def test_a_batch_writes_what_it_changes(spark, scratch):
    log = statelog.StateLog(spark, scratch + "/log", SCHEMA, ["k"])
    log.write(spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
              .coalesce(1), 0)
    whole = _bytes(scratch + "/log")
    written = []
    for b in range(1, 10):
        seen = {s for s in log.segments()}
        log.write(spark.createDataFrame([(b, f"{b}")], SCHEMA).coalesce(1), b)
        new = [s for s in log.segments() if s not in seen]
        written.append(sum(_bytes(log._folder(s)) for s in new))
    assert max(written) < whole / 100                   # the large segment stays as it is
    assert len(log.current()) <= 5
    # as many rows again: now it is merged
    log.write(spark.range(200_000, 400_000).select(F.col("id").alias("k"), F.lit("x").alias("v")).coalesce(1), 10)
    log.write(spark.range(150_000).select(F.col("id").alias("k"), F.sha2(F.lit("y"), 256).alias("v")), 11)
    assert log.read().count() == 400_000
