"""Stream = batch: Q10s and Q12s over events files delivered one per
micro-batch, with a restart from the checkpoint, and the documented
difference when files arrive out of order."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from rollcall.operators import convergence, coverage, parse
from rollcall.operators.state import apply_checkins
from rollcall.sources import views
from rollcall.sources.streams import parquet_stream
from rollcall.streaming import coverage as cov_stream
from rollcall.streaming import latch as latch_stream

BOUNDS = [0, 2500, 5000, 7500, 10_000]


def _split_events(spark, folder, order=(0, 1, 2, 3)):
    """Write the events in four event_id ranges, one file each, in ``order``."""
    ev = spark.read.parquet(os.path.join(SF_MID, "events.parquet"))
    for k in order:
        (ev.where((F.col("event_id") >= BOUNDS[k]) & (F.col("event_id") < BOUNDS[k + 1]))
         .coalesce(1).write.mode("append").parquet(folder))


def _segments(state):
    """Folders of the state log of a stream."""
    logs = [os.path.join(state, n) for n in ("rows", "latches") if os.path.isdir(os.path.join(state, n))]
    return [d for log in logs for d in os.listdir(log) if d.startswith("batches-")]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def fleet(spark):
    return views.fleet(spark, SF_MID)


@pytest.fixture(scope="module")
def batch_probes(spark):
    return parse.parse_probes(views.probes(spark, SF_MID))


def test_coverage_stream_many_batches_and_restart(spark, scratch, fleet):
    src = os.path.join(scratch, "in")
    ev = spark.read.parquet(os.path.join(SF_MID, "events.parquet"))
    for k in (0, 1, 2):
        (ev.where((F.col("event_id") >= BOUNDS[k]) & (F.col("event_id") < BOUNDS[k + 1]))
         .coalesce(1).write.mode("append").parquet(src))
    state, ckpt = os.path.join(scratch, "state"), os.path.join(scratch, "ckpt")

    def run():
        stream = views.checkins_from(parquet_stream(spark, src, max_files_per_trigger=1))
        q = cov_stream.start_coverage_stream(fleet, stream, state, ckpt)
        q.awaitTermination()
        return q

    q = run()
    assert q.lastProgress is not None
    assert 1 <= len(_segments(state)) <= 4
    # the fourth file arrives later; the query resumes from its checkpoint
    (ev.where(F.col("event_id") >= BOUNDS[3]).coalesce(1).write.mode("append").parquet(src))
    run()
    batch = coverage.report_coverage(fleet, parse.parse_checkins(views.checkins(spark, SF_MID)))
    assert _rows(cov_stream.coverage_from_state(spark, fleet, state)) == _rows(batch)


@pytest.mark.parametrize("target", [True, False])
def test_latch_stream_equals_batch(spark, scratch, fleet, batch_probes, target):
    src = os.path.join(scratch, "in")
    _split_events(spark, src)
    state, ckpt = os.path.join(scratch, "state"), os.path.join(scratch, "ckpt")
    stream = views.probes_from(parquet_stream(spark, src, max_files_per_trigger=1))
    q = latch_stream.start_latch_stream(fleet, stream, target, state, ckpt)
    q.awaitTermination()
    got = _rows(latch_stream.latches_from_state(spark, fleet, state))
    assert got == _rows(convergence.ordered_latch(fleet, batch_probes, target))
    assert len(got) > 0


@pytest.mark.parametrize("kind", ["latch", "coverage"])
def test_replayed_batch_is_idempotent(spark, scratch, fleet, batch_probes, kind):
    """The last batch wrote its state, but the query died before its commit."""
    src = os.path.join(scratch, "in")
    _split_events(spark, src)
    state, ckpt = os.path.join(scratch, "state"), os.path.join(scratch, "ckpt")

    def run():
        events = parquet_stream(spark, src, max_files_per_trigger=1)
        if kind == "latch":
            latch_stream.start_latch_stream(fleet, views.probes_from(events), True, state,
                                            ckpt).awaitTermination()
            return _rows(latch_stream.latches_from_state(spark, fleet, state))
        cov_stream.start_coverage_stream(fleet, views.checkins_from(events), state,
                                         ckpt).awaitTermination()
        return _rows(cov_stream.inventory_from_state(spark, fleet, state))

    before = run()
    last = max(int(n) for n in os.listdir(os.path.join(ckpt, "commits")) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        path = os.path.join(ckpt, "commits", name)
        if os.path.exists(path):
            os.remove(path)
    assert run() == before
    assert len(_segments(state)) <= 6


def test_patch_stream_equals_batch_on_text_clusters(spark, scratch, fleet):
    """Clusters as text (as the inventory reader gives them), many batches."""
    named = fleet.withColumn("cluster", F.format_string("%03d", "cluster"))
    src = os.path.join(scratch, "in")
    _split_events(spark, src)
    events = parquet_stream(spark, src, max_files_per_trigger=1)
    state = os.path.join(scratch, "state")
    empty = cov_stream.coverage_from_state(spark, named, state)
    assert all(r.reported == 0 for r in empty.collect())
    cov_stream.start_coverage_stream(named, views.checkins_from(events), state,
                                     os.path.join(scratch, "ckpt")).awaitTermination()
    checkins = parse.parse_checkins(views.checkins(spark, SF_MID))
    assert _rows(cov_stream.inventory_from_state(spark, named, state)) == _rows(
        apply_checkins(named, checkins))
    assert _rows(cov_stream.coverage_from_state(spark, named, state)) == _rows(
        coverage.report_coverage(named, checkins))


def test_latch_stream_on_text_clusters(spark, scratch, fleet, batch_probes):
    named = fleet.withColumn("cluster", F.format_string("%03d", "cluster"))
    src = os.path.join(scratch, "in")
    _split_events(spark, src)
    state = os.path.join(scratch, "state")
    assert latch_stream.latches_from_state(spark, named, state).count() == 0
    stream = views.probes_from(parquet_stream(spark, src, max_files_per_trigger=1))
    latch_stream.start_latch_stream(named, stream, True, state,
                                    os.path.join(scratch, "ckpt")).awaitTermination()
    got = _rows(latch_stream.latches_from_state(spark, named, state))
    assert got == _rows(convergence.ordered_latch(named, batch_probes, True))


def test_latch_stream_out_of_order_differs(spark, scratch, fleet, batch_probes):
    """Delivery order matters for the ordered wait: the last quarter first."""
    src = os.path.join(scratch, "in")
    _split_events(spark, src, order=(3, 0, 1, 2))
    state = os.path.join(scratch, "state")
    stream = views.probes_from(parquet_stream(spark, src, max_files_per_trigger=1))
    latch_stream.start_latch_stream(fleet, stream, True, state,
                                    os.path.join(scratch, "ckpt")).awaitTermination()
    got = _rows(latch_stream.latches_from_state(spark, fleet, state))
    assert got != _rows(convergence.ordered_latch(fleet, batch_probes, True))


def test_latch_stream_restart_from_checkpoint(spark, scratch, fleet, batch_probes):
    """Three files, stop; a fourth arrives; the query resumes from its
    checkpoint and pointer table and ends where the batch job does."""
    src = os.path.join(scratch, "in")
    ev = spark.read.parquet(os.path.join(SF_MID, "events.parquet"))
    for k in (0, 1, 2):
        (ev.where((F.col("event_id") >= BOUNDS[k]) & (F.col("event_id") < BOUNDS[k + 1]))
         .coalesce(1).write.mode("append").parquet(src))
    state, ckpt = os.path.join(scratch, "state"), os.path.join(scratch, "ckpt")

    def run():
        stream = views.probes_from(parquet_stream(spark, src, max_files_per_trigger=1))
        latch_stream.start_latch_stream(fleet, stream, True, state, ckpt).awaitTermination()

    run()
    first = _rows(latch_stream.latches_from_state(spark, fleet, state))
    (ev.where(F.col("event_id") >= BOUNDS[3]).coalesce(1).write.mode("append").parquet(src))
    run()
    got = _rows(latch_stream.latches_from_state(spark, fleet, state))
    assert set(first) <= set(got)
    assert got == _rows(convergence.ordered_latch(fleet, batch_probes, True))


def test_await_full_coverage_stops_the_stream(spark, scratch, fleet):
    """A processing-time stream stops itself once every node has reported."""
    src = os.path.join(scratch, "in")
    _split_events(spark, src)
    state, ckpt = os.path.join(scratch, "state"), os.path.join(scratch, "ckpt")
    stream = views.checkins_from(parquet_stream(spark, src, max_files_per_trigger=1))
    q = cov_stream.start_coverage_stream(fleet, stream, state, ckpt,
                                         trigger={"processingTime": "1 second"})
    cov = cov_stream.await_full_coverage(spark, q, fleet, state, timeout_seconds=240)
    assert not q.isActive
    rows = cov.collect()
    assert rows and all(r.pending == 0 and r.cutoff_seq is not None for r in rows)
    batch = coverage.report_coverage(fleet, parse.parse_checkins(views.checkins(spark, SF_MID)))
    assert _rows(cov) == _rows(batch)
