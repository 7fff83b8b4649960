"""Conversation structure repair: faults, and the cheapest edits that mend them.

Rows of a conversation stand in the order of turn (nulls first), role and the
digest of the text. The first fault of a row counts: blank (no character but
white space), duplicate (role and text seen earlier), truncated (the last
such character is not one of ``.!?``). Blank and duplicate rows must be deleted;
the other edits and their costs are those of ``turn_grammar``, which finds the
cheapest audit by a dynamic program over a Re-Pair grammar of role/fault
sequences, with one matrix a rule for all conversations of a block.

As Spark jobs:

1. Narrow rows (no text, but its digest), equal ones counted together before the
   shuffle. An aggregate on (conversation, role, digest) finds what is repeated
   and its first turn; those few come back by a join.
2. The narrow rows are dealt by ranges of (conversation, order), so a
   conversation with a third of all rows is many pieces. A task folds each of its
   pieces; the first may begin anywhere, so it is folded from every state.
3. The pieces of a conversation, a row each, are multiplied in order.
4. ``repaired_rows`` and ``repaired_digests`` replay the audit over the texts, a row
   at a time, in one pass over a conversation: its place in the result and a
   digest of all of it depend on all before it. Nothing of a conversation is
   held but its audit, a byte a row.

Defined results: null role or text is empty; rows without conv_id form one
conversation; rows equal in all columns are kept apart (the second and later
ones are duplicates); an empty table gives an empty report; other columns stay
out, whatever their names. Texts of any length pass row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, LongType, StringType, StructField, StructType)

from rollcall.llm import turn_grammar as G
from rollcall.llm.common import bounded_batches, written

WHITE = " \t\n\x0b\x0c\r"
#: symbols whose grammar is made at a time
BLOCK = 1 << 16
_NEIGHBOURS = ("su", "ua", "au")
_FAULTS = ("blank", "duplicate", "truncated")
_ORDER = ["conv_id", "turn", "role", "digest"]


def _source(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def _narrow(source: DataFrame) -> DataFrame:
    """Rows without text: how often each stands there, whether it is blank or
    truncated, whether its first copy is the first of its role and text."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = written(
        source.select(*_ORDER, (end == "").alias("blank"),
                      (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
        .groupBy(*_ORDER, "blank", "truncated").agg(F.count(F.lit(1)).alias("n")), "repair-rows")
    key = ["conv_id", "role", "digest"]
    again = written(
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_turns"), F.max(F.col("turn").isNull()).alias("_null"),
                               F.min("turn").alias("_first"))
        .where("_turns > 1").drop("_turns").withColumnsRenamed({k: f"_{k}" for k in key}), "repair-again")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    first = (F.when(F.col("_null").isNull(), True).when(F.col("_null"), F.col("turn").isNull())
             .otherwise(F.col("turn") == F.col("_first")))
    return (rows.join(again, same, "left")
            .select(*_ORDER, "blank", "truncated", "n", F.coalesce(first, F.lit(False)).alias("first")))


class _Piece:
    """What one task has seen of one conversation."""

    def __init__(self, conv, open_start: bool):
        self.conv = conv
        starts = range(G.STATES) if open_start else [0]
        self.vectors = {s: {s: (0, G.EMPTY)} for s in starts}
        self.symbols = bytearray()
        self.rows = self.illegal = self.turns = 0
        self.faults = [0, 0, 0]
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, blank: bool, truncated: bool, n: int, first: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in _NEIGHBOURS:
            self.illegal += 1
        if n > 1 and initial + initial not in _NEIGHBOURS:
            self.illegal += n - 1
        self.last = initial
        self.rows += n
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        stays = int(first and not blank)
        if stays:
            self.symbols.append(G.symbol(initial, truncated))
            self.faults[2] += truncated
        self.faults[0 if blank else 1] += n - stays
        self.symbols += bytes([G.MUST_GO]) * (n - stays)

    def row(self, place: int) -> tuple:
        costs, audits = [-1] * 16, [None] * 16
        for i, vector in self.vectors.items():
            for j, (cost, audit) in vector.items():
                costs[4 * i + j], audits[4 * i + j] = cost, str(audit)
        return (self.conv, place, self.rows, *self.faults, self.illegal, self.first, self.last,
                self.turns, self.low, self.high, costs, audits)


def _fold(pieces: list[_Piece]) -> None:
    """Fold what has gathered in the pieces, with one grammar for all."""
    grammar = G.Grammar([bytes(p.symbols) for p in pieces])
    for p in pieces:
        sequence, p.symbols = bytes(p.symbols), bytearray()
        if p.vectors == {0: {0: (0, G.EMPTY)}}:
            p.vectors = {0: grammar.from_start(sequence)}
        else:
            p.vectors = {s: grammar.fold(v, sequence) for s, v in p.vectors.items()}


def _piece_schema(types: dict) -> StructType:
    long, text = LongType(), StringType()
    return StructType([
        StructField("conv_id", types["conv_id"]), StructField("place", long), StructField("rows", long),
        *[StructField(f, long) for f in _FAULTS], StructField("illegal", long),
        StructField("first", text), StructField("last", text), StructField("turns", long),
        StructField("low", types["turn"]), StructField("high", types["turn"]),
        StructField("costs", ArrayType(long)), StructField("audits", ArrayType(text))])


def _pieces(narrow: DataFrame) -> DataFrame:
    """One row per conversation and range, with the ways through it from the
    first state, or from every state where the range begins within it."""
    schema = _piece_schema({f.name: f.dataType for f in narrow.schema.fields})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        arrow: pa.Schema | None = None
        now: _Piece | None = None
        done: list[_Piece] = []
        held = 0

        def rows() -> pa.RecordBatch:
            nonlocal place
            _fold(done)
            out = [p.row(place + k) for k, p in enumerate(done)]
            place += len(done)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

        for batch in batches:
            if arrow is None:
                arrow = _arrow(schema, batch)
            for conv, turn, role, blank, cut, n, first in zip(
                    *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "truncated",
                                                            "n", "first"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now)
                        if held >= BLOCK or len(done) >= BLOCK:
                            yield rows()
                            held = 0
                    now = _Piece(conv, open_start=now is None)
                while n > 0:                   # a run of equal rows in blocks, too
                    part = min(n, BLOCK)
                    now.add(turn, role, blank, cut, part, first)
                    n, held, first = n - part, held + part, False
                    if len(now.symbols) >= BLOCK:
                        _fold([now])
        if now is not None:
            done.append(now)
            yield rows()

    return (narrow.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
            .select("conv_id", "turn", "role", "blank", "truncated", "n", "first")
            .mapInArrow(fold, schema))


def _arrow(schema: StructType, batch: pa.RecordBatch) -> pa.Schema:
    """The Arrow schema of the pieces, with the batch's types of id and turn."""
    conv, turn = batch.schema.field("conv_id").type, batch.schema.field("turn").type
    own = {"conv_id": conv, "low": turn, "high": turn, "first": pa.string(), "last": pa.string(),
           "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
    return pa.schema([(f.name, own.get(f.name, pa.int64())) for f in schema.fields])


def _none(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """A piece without rows for each id."""
    zero = {"place": -1, "rows": 0, "illegal": 0, "turns": 0, **dict.fromkeys(_FAULTS, 0)}
    return ids.select(*[F.col("conv_id") if f.name == "conv_id" else
                        F.lit(zero.get(f.name)).cast(f.dataType).alias(f.name) for f in pieces.schema.fields])


def _report(pieces: DataFrame) -> DataFrame:
    """The pieces of each conversation multiplied in order."""
    types = {f.name: f.dataType for f in pieces.schema.fields}
    names = ("gaps", *_FAULTS, "illegal", "cost")
    schema = StructType([StructField("conv_id", types["conv_id"]),
                         *[StructField(n, LongType()) for n in names], StructField("audit", StringType())])

    class Total:
        def __init__(self, conv):
            self.conv, self.vector = conv, {0: (0, G.EMPTY)}
            self.faults, self.illegal, self.turns = [0, 0, 0], 0, 0
            self.last = self.low = self.high = None

        def add(self, r: dict) -> None:
            if not r["rows"]:
                return
            if self.last is not None and self.last + r["first"] not in _NEIGHBOURS:
                self.illegal += 1
            self.last = r["last"]
            self.illegal += r["illegal"]
            self.faults = [a + r[f] for a, f in zip(self.faults, _FAULTS)]
            self.turns += r["turns"] - (r["low"] is not None and r["low"] == self.high)
            self.low = r["low"] if self.low is None else self.low
            self.high = self.high if r["high"] is None else r["high"]
            matrix = [{j: (r["costs"][4 * i + j], G.Rope(r["audits"][4 * i + j])) for j in range(4)
                       if r["audits"][4 * i + j] is not None} for i in range(4)]
            self.vector = G.times(self.vector, matrix)

        def row(self) -> tuple:
            cost, audit = G.finished(self.vector)
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (self.conv, gaps, *self.faults, self.illegal, cost, audit)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Total | None = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or now.conv != r["conv_id"]:
                    if now is not None:
                        out.append(now.row())
                    now = Total(r["conv_id"])
                now.add(r)
            id_type = batch.schema.field("conv_id").type
            if out:
                yield _batch(out, schema, id_type)
        if now is not None:
            yield _batch([now.row()], schema, id_type)

    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place")
            .mapInArrow(multiply, schema))


def _batch(rows: list[tuple], schema: StructType, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.string() if isinstance(f.dataType, StringType) else pa.int64()
                        for f in schema.fields[1:]]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=schema.names)


def repair_report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of
    conversations (conv_id, turn, role, text), and of the conv_ids of ``ids`` that
    have no rows. ``gaps`` is the number of turns missing between the first and
    the last, ``illegal`` that of neighbours whose roles' initials are not su, ua
    or au; ``audit`` has the initials of the edits in order."""
    bounded_batches(conversations.sparkSession)
    pieces = _pieces(_narrow(_source(conversations)))
    if ids is not None:
        pieces = pieces.unionByName(_none(pieces, ids.select("conv_id").distinct()))
    return _report(pieces)


def _replay_input(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """Every conversation's report row, then its rows in order."""
    rows = _source(conversations).withColumn("_report", F.lit(None).cast(
        StructType([f for f in report.schema.fields if f.name != "conv_id"])))
    heads = report.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                          *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("role", "text", "digest")],
                          F.struct(*[c for c in report.columns if c != "conv_id"]).alias("_report"))
    return (heads.unionByName(rows).withColumn("_row", F.col("_report").isNull())
            .repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "role", "digest")
            .select("conv_id", "role", "text", "_report"))


class _Replay:
    """The audit of one conversation, followed row by row."""

    def __init__(self, conv, report: dict):
        self.conv, self.report = conv, report
        self.audit, self.at, self.state, self.place = report["audit"], 0, 0, 0
        self.sha = hashlib.sha256()

    def _out(self, role: str, initial: str, text: str, edit: str) -> tuple:
        self.state = G.AFTER[self.state, initial]
        self.place += 1
        return self.conv, self.place - 1, role, text, edit

    def _due(self) -> tuple[str, str]:
        return ("assistant", "a") if self.state == 2 else ("user", "u")

    def inserts(self) -> Iterator[tuple]:
        """The inserted rows that come next."""
        while self.at < len(self.audit) and self.audit[self.at] == G.INSERT:
            self.at += 1
            yield self._out(*self._due(), "", G.INSERT)

    def row(self, role: str, text: str) -> Iterator[tuple]:
        """What comes out up to and with a row of the source."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == G.KEEP:
            yield self._out(role, role[:1], text, edit)
        elif edit == G.REROLE:
            yield self._out(*self._due(), text, edit)

    def feed(self, rows: Iterator[tuple]) -> None:
        for _, place, role, text, _ in rows:
            self.sha.update((("\n" if place else "") + f"{role}:{text}").encode())


def repaired_rows(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the conversations after the edits of
    their report, ``place`` from 0."""
    bounded_batches(conversations.sparkSession)
    source = _replay_input(conversations, report)
    schema = StructType([source.schema["conv_id"], StructField("place", LongType()),
                         *[StructField(n, StringType()) for n in ("role", "text", "edit")]])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Replay | None = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            out = []
            for conv, role, text, head in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if head is None:
                    out += now.row(role, text)
                    continue
                if now is not None:
                    out += now.inserts()
                now = _Replay(conv, head)
            if out:
                yield _batch(out, schema, id_type)
        rest = list(now.inserts()) if now is not None else []
        if rest:
            yield _batch(rest, schema, id_type)

    return source.mapInArrow(replay, schema)


def repaired_digests(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """The report with ``repaired_sha256``: the digest of the repaired
    conversation as ``role:text`` lines, taken as the rows pass."""
    bounded_batches(conversations.sparkSession)
    schema = StructType([*report.schema.fields, StructField("repaired_sha256", StringType())])

    def closed(now: _Replay) -> tuple:
        now.feed(now.inserts())
        return (now.conv, *[now.report[n] for n in schema.names[1:-1]], now.sha.hexdigest())

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Replay | None = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            out = []
            for conv, role, text, head in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if head is None:
                    now.feed(now.row(role, text))
                    continue
                if now is not None:
                    out.append(closed(now))
                now = _Replay(conv, head)
            if out:
                yield _batch(out, schema, id_type)
        if now is not None:
            yield _batch([closed(now)], schema, id_type)

    return _replay_input(conversations, report).mapInArrow(replay, schema)
