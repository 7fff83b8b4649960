"""A large commented JSON array read by many tasks.

Text is cut behind every ``}``, by Spark's own text reader, so a file is split like
any other. Where a piece stands is not known from the piece alone: its ``}`` may lie in
a string or a comment. So a piece is taken as a function: for each of the five
states a ``}`` can leave (plain text, a string in double or single quotes, a
comment to the end of the line, a block comment) the state after the piece and by
how much the depth of brackets changes. (After a ``}`` no escape and no half of a
comment mark is pending, so there are no more states.)

1. The pieces and their functions are written once, made with regular expressions
   in one pass.
2. Functions are composed along each split of a file, then along the splits of
   each file; that gives every piece its true state and depth.
3. A piece that ends in plain text at depth 1 ends an element of the array.
   Pieces up to there are one segment: the bytes of an element with what stands
   before it. An element over several splits is put together there.
4. Each segment is parsed as an array of its own by Spark's JSON parser
   (FAILFAST). Behind the first it starts with a null in place of what went before, so
   a missing or trailing comma is the error it is in the whole file; and it ends
   with a mark, so an array that closes too early is one as well.
5. ``idx`` is the prefix sum of the elements of the segments.

No task holds more than a split's narrow numbers or one element's text. A file whose
root is not an array is one segment, parsed as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.operators.scan import ordered_scan
from rollcall.session import written_table

#: what opens the states 1 to 4; state 0 is plain text
OPENERS = ['"', "'", "//", "/*"]
_TOKEN = (r'''(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+\''''
          r'''|//[^\r\n]*+[\r\n]|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/''')
_OPEN = r'''("|'|//|/\*)'''
_MARK = "\x00end of segment"

#: a state, the first character seen (0 none yet, 1 a bracket, 2 another) and a
#: depth in one number
STATE, LEAD, DEPTH = 7, 3, 5


def piece_function(text: Column) -> Column:
    """Per state before the piece: state after it, first plain character and change of
    depth, coded in one number."""
    out = []
    for opener in ["", *OPENERS]:
        rest = F.regexp_replace(F.concat(F.lit(opener), text, F.lit("}")), _TOKEN, " ")
        opened = F.regexp_extract(rest, _OPEN, 1)
        plain = F.regexp_replace(rest, "(?s)" + _OPEN + ".*+", "")
        state = F.lit(0)
        for number, mark in enumerate(OPENERS, 1):
            state = F.when(opened == mark, number).otherwise(state)
        depth = (F.length(F.regexp_replace(plain, r"[^\[{]++", ""))
                 - F.length(F.regexp_replace(plain, r"[^\]}]++", "")))
        first = F.regexp_extract(plain, r"^\s*+(\S)", 1)
        lead = F.when(first == "", 0).when(first == "[", 1).otherwise(2)
        out.append(F.shiftleft(depth, DEPTH).bitwiseOR(F.shiftleft(lead, LEAD)).bitwiseOR(state))
    return F.array(*out)


def _composed(pieces: DataFrame) -> DataFrame:
    """(path, block, place, after): the pieces' functions composed from the start of their
    split to the end of each."""
    state_bits, lead_at, depth_at = STATE, LEAD, DEPTH

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes = None, []
        for b in batches:
            out = []
            for path, block, step in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if (path, block) != now:
                    now, codes = (path, block), list(range(5))
                new = []
                for c in codes:
                    s = step[c & state_bits]
                    lead = (c >> lead_at) & 3 or (s >> lead_at) & 3
                    new.append(((c >> depth_at) + (s >> depth_at)) << depth_at | lead << lead_at | s & state_bits)
                codes = new
                out.append(codes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int32()))],
                                             names=["path", "block", "place", "after"])

    return (pieces.select("path", "block", "place", "step").repartition("path", "block")
            .sortWithinPartitions("path", "block", "place")
            .mapInArrow(compose, "path string, block long, place long, after array<int>"))


def _split_starts(splits: DataFrame) -> DataFrame:
    """(path, block, code, tail): the code each split starts with, and the place of
    its last piece if it is its file's last. One row a split."""
    state_bits, lead_at, depth_at = STATE, LEAD, DEPTH

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        codes, now = [], 0
        for total in rows["total"]:
            codes.append(now)
            s = int(total[now & state_bits])
            lead = (now >> lead_at) & 3 or (s >> lead_at) & 3
            now = ((now >> depth_at) + (s >> depth_at)) << depth_at | lead << lead_at | s & state_bits
        tail = [-1] * (len(rows) - 1) + [int(rows["last"].iloc[-1])]
        return pd.DataFrame({"path": rows["path"], "block": rows["block"], "code": codes, "tail": tail})

    return splits.groupBy("path").applyInPandas(starts, "path string, block long, code int, tail long")


def segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, seg, text, last): the files cut behind elements of their arrays."""
    raw = spark.read.option("lineSep", "}").text(paths)
    pieces = written_table(raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"),
        piece_function(F.col("value")).alias("step")), "inventory-pieces")
    composed = written_table(_composed(pieces), "inventory-states")
    starts = _split_starts(composed.groupBy("path", "block").agg(
        F.max_by("after", "place").alias("total"), F.max("place").alias("last")))

    own = F.element_at("after", F.col("code").bitwiseAND(STATE) + 1)
    depth = F.shiftright(own, DEPTH) + F.shiftright("code", DEPTH)
    before = F.shiftright("code", LEAD).bitwiseAND(3)
    lead = F.when(before != 0, before).otherwise(F.shiftright(own, LEAD).bitwiseAND(3))
    ends = ((own.bitwiseAND(STATE) == 0) & (depth == 1) & (lead == 1)
            & (F.col("place") != F.col("tail")))
    placed = composed.join(starts, ["path", "block"]).select(
        "path", "block", "place", "tail", ends.cast("long").alias("ends"))
    in_split = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = written_table(
        placed.withColumn("before", F.coalesce(F.sum("ends").over(in_split), F.lit(0))), "inventory-ends")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (placed.groupBy("path", "block").agg(F.sum("ends").alias("n"))
             .select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    # a file that ends in the very mark it is cut behind has one byte more
    whole = pieces.groupBy("path").agg(
        (F.sum(F.octet_length("text") + 1) == F.max("size")).alias("whole"))
    last = F.col("place") == F.col("tail")
    numbered = placed.join(bases, ["path", "block"]).join(whole, "path").select(
        "path", "block", "place", (F.col("base") + F.col("before")).alias("seg"), last.alias("last"),
        F.when(last & F.col("whole"), "}").otherwise("").alias("close"))
    return (pieces.select("path", "block", "place", "text").join(numbered, ["path", "block", "place"])
            .groupBy("path", "seg")
            .agg(F.concat(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("block", "place", "text"))),
                lambda p: p["text"]), "}"), F.max("close")).alias("text"), F.max("last").alias("last")))


def read_split_arrays(spark: SparkSession, paths: list[str], schema: str, options: dict[str, str],
                      field: str) -> DataFrame:
    """(path, idx, r): the elements of the arrays in the files, in file order.
    ``field`` is a string field of the elements, for the mark. Runs jobs, as the
    pieces and the parsed rows are written."""
    cut = segments(spark, paths)
    text = F.concat(F.when(F.col("seg") > 0, "[null ").otherwise(""), "text",
                    F.when(F.col("last"), "").otherwise(
                        F.concat(F.lit("}, "), F.to_json(F.struct(F.lit(_MARK).alias(field))), F.lit("]"))))
    rows = cut.select("path", "seg", "last", F.from_json(text, schema, options).alias("rows"))
    closed = F.element_at("rows", -1)[field].eqNullSafe(_MARK)
    checked = rows.select("path", "seg", F.when(F.col("last") | closed, F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit("the array of "), "path", F.lit(" ends before the file does")))
    ).alias("rows"), "last")
    skip, drop = (F.col("seg") > 0).cast("int"), (~F.col("last")).cast("int")
    elements = F.slice("rows", skip + 1, F.size("rows") - skip - drop)
    parsed = written_table(checked.where("rows IS NOT NULL")
                           .select("path", "seg", elements.alias("rows")), "inventory-rows")
    counts = parsed.select("path", "seg", F.size("rows").cast("long").alias("n"))
    upto = ordered_scan(counts, ["path"], ["seg"], "n", "upto", "running_sum")
    return (parsed.join(upto.select("path", "seg", (F.col("upto") - F.col("n")).alias("base")), ["path", "seg"])
            .select("path", "base", F.posexplode("rows").alias("pos", "r"))
            .select("path", (F.col("base") + F.col("pos")).alias("idx"), "r"))
