"""Ordered scans per key that stay parallel when one key is huge.

A window ``PARTITION BY key ORDER BY o`` puts every row of a key into one
task. When one cluster or one node holds a third of all rows, that task is the
whole job. The scans here give the same answer as the window, but split a
key's ordered rows into range chunks and run the window inside each chunk:

1. ``repartitionByRange(P, *keys, *order)``: the chunks are contiguous,
   ordered slices of the global (key, order) sequence, sized by sampling, so
   a hot key is spread over many chunks. The chunk id is the partition id;
   the tagged rows are checkpointed to the shared folder so every branch below
   sees the same chunks (and a lost executor cannot re-draw them).
2. The window runs per (chunk, key): at most one chunk of rows per task.
3. One summary row per (chunk, key) (sum, last value, min) and a window over
   those summaries per key give each chunk the carry-in from the other chunks
   of its key. A key spans at most P chunks, so that window is small.
4. The carry is joined back on (chunk, key) and combined with the local value.

When an aggregate shows every key is small (``max_group_rows``), the plain
window is used instead: same result, one shuffle, no checkpoint.

Keys must be non-null. The order columns must order the rows of a key
totally, up to rows that are equal in ``value`` as well; then both paths give
the same result, so which one runs (a matter of sizes) never shows. Rows with
equal keys and order lie in one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import cut_lineage

#: group size up to which the plain window is used (rows per key)
DEFAULT_MAX_GROUP_ROWS = 1_000_000
#: target rows per chunk on the split path (narrow rows: keys, order, value)
DEFAULT_CHUNK_ROWS = 8_000_000

_CHUNK = "_rc_chunk"
_LOCAL = "_rc_local"
_SUMMARY = "_rc_summary"
_CARRY = "_rc_carry"
_FIRST = "_rc_first"

_KINDS = ("running_sum", "previous", "last", "min_following")


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def _group_stats(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(largest group, total rows), from a partial/final aggregate."""
    row = (df.groupBy(*keys).count()
           .agg(F.max("count").alias("mx"), F.sum("count").alias("tot"))
           .first())
    return int(row["mx"] or 0), int(row["tot"] or 0)


def split_decision(df: DataFrame, largest: int, total: int,
                   max_group_rows: int | None = None) -> tuple[bool, int]:
    """(split?, chunks) for a scan whose largest group has ``largest`` rows
    out of ``total``; the same rule ``ordered_scan`` applies itself."""
    limit = max_group_rows if max_group_rows is not None else _conf_int(
        df, "rollcall.scan.maxGroupRows", DEFAULT_MAX_GROUP_ROWS)
    base = _conf_int(df, "spark.sql.shuffle.partitions", 200)
    chunk_rows = _conf_int(df, "rollcall.scan.chunkRows", DEFAULT_CHUNK_ROWS)
    return largest > limit, max(base, math.ceil(total / max(chunk_rows, 1)))


def _window(partition: list[str], order: list[str], kind: str):
    # "min over the rows after this one" is the running min over the rows
    # before it in reverse order: Spark evaluates a frame that starts at
    # unbounded preceding incrementally, but re-aggregates an unbounded
    # following frame for every row (quadratic in the group).
    if kind == "min_following":
        return Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order])
    return Window.partitionBy(*partition).orderBy(*order)


def _window_value(kind: str, value: str, w) -> Column:
    if kind == "running_sum":
        return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if kind == "previous":
        return F.lag(value, 1).over(w)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 value: str, out: str, kind: str, *,
                 split: bool | None = None,
                 max_group_rows: int | None = None,
                 num_chunks: int | None = None) -> DataFrame:
    """Add column ``out``: a scan of ``value`` over the rows of each key in
    ``order``.

    kind:
      * ``running_sum``   sum of value over this and all earlier rows
      * ``previous``      value of the row just before (null for the first)
      * ``last``          latest value that is not null, of this row or an earlier one
      * ``min_following`` least value over all later rows (null if none)

    split: True forces the chunked path, False the plain window, None decides
    from the largest group (one aggregate) against ``max_group_rows``.
    """
    if kind not in _KINDS:
        raise ValueError(f"kind must be one of {_KINDS}")
    keys, order = list(keys), list(order)
    if split is None or (split and num_chunks is None):
        largest, total = _group_stats(df, keys)
        need, chunks = split_decision(df, largest, total, max_group_rows)
        split = need if split is None else split
        num_chunks = num_chunks or chunks
    if not split:
        return df.withColumn(out, _window_value(kind, value, _window(keys, order, kind)))
    return _chunked_scan(df, keys, order, value, out, kind, num_chunks or 1)


def _chunked_scan(df: DataFrame, keys: list[str], order: list[str], value: str,
                  out: str, kind: str, num_chunks: int) -> DataFrame:
    tagged = cut_lineage(
        df.repartitionByRange(num_chunks, *keys, *order)
        .withColumn(_CHUNK, F.spark_partition_id()))

    w_local = _window([_CHUNK, *keys], order, kind)
    local = tagged.withColumn(_LOCAL, _window_value(kind, value, w_local))
    if kind == "previous":
        local = local.withColumn(_FIRST, F.lag(F.lit(1), 1).over(w_local).isNull())

    if kind == "running_sum":
        summary = F.sum(value)
    elif kind == "previous":
        summary = F.max_by(F.col(value), F.struct(*order))
    elif kind == "last":
        summary = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    else:
        summary = F.min(value)
    summaries = tagged.groupBy(_CHUNK, *keys).agg(summary.alias(_SUMMARY))

    w_chunks = _window(keys, [_CHUNK], kind)
    if kind == "running_sum":
        carry = F.sum(_SUMMARY).over(w_chunks.rowsBetween(Window.unboundedPreceding, -1))
    elif kind == "previous":
        carry = F.lag(_SUMMARY, 1).over(w_chunks)
    elif kind == "last":
        carry = F.last(_SUMMARY, ignorenulls=True).over(w_chunks.rowsBetween(Window.unboundedPreceding, -1))
    else:  # chunks in reverse order: the min over the chunks after this one
        carry = F.min(_SUMMARY).over(w_chunks.rowsBetween(Window.unboundedPreceding, -1))
    carries = summaries.select(_CHUNK, *keys, carry.alias(_CARRY))

    joined = local.join(carries, on=[_CHUNK, *keys], how="left")
    if kind == "running_sum":
        # a null local sum (only nulls so far in this chunk) is the carry alone
        result = F.coalesce(F.col(_LOCAL) + F.coalesce(F.col(_CARRY), F.lit(0)), F.col(_CARRY))
    elif kind == "previous":
        result = F.when(F.col(_FIRST), F.col(_CARRY)).otherwise(F.col(_LOCAL))
    elif kind == "last":
        result = F.coalesce(_LOCAL, _CARRY)
    else:
        result = F.least(F.col(_LOCAL), F.col(_CARRY))
    dropped = [_CHUNK, _LOCAL, _CARRY] + ([_FIRST] if kind == "previous" else [])
    return joined.withColumn(out, result).drop(*dropped)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              out: str = "idx", **kw) -> DataFrame:
    """0-based position of each row within its key, in ``order``
    (``row_number() - 1``), computed as a running count."""
    one = "_rc_one"
    res = ordered_scan(df.withColumn(one, F.lit(1).cast("long")), keys, order,
                       one, out, "running_sum", **kw)
    return res.withColumn(out, (F.col(out) - 1).cast("long")).drop(one)
