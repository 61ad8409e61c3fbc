"""Operator 11, repair of the turn structure of conversations by dynamic programming.

A repaired conversation's role initials are ``(s?(ua)+)?``. Rows are kept (0), get another role (2) or are deleted (3,
which blank and repeated ones must be), empty turns are inserted (2), and each truncated row that stays adds 1. A state of
the grammar is what stood last: nothing, s, u or a; each leaves one role that can follow from user and assistant, so an
edit's letter tells all. Costs to go run backward over rows and states; the walk runs forward and takes, of the edits
whose cost is tight, the first in ASCII. It ends where the cost to go is 0, so that the whole audit is the least one.

A conversation may have very many rows, so it is cut into pieces of ``PIECE`` places at most:

* Each piece makes its table of costs from state to state (a min-plus product over its rows) and its summary.
* Pieces of a conversation, not its rows, are read backward for the costs to go at the end of each.
* Each piece walks from each of the four states, and pieces are read forward to choose the walks that connect.
* Only the digest of the repaired text, which has no parts, reads a conversation's rows one after another; rows are
  sorted and streamed, so no conversation is ever held.

Rows of a conversation go by turn (nulls first), then role, then text. Defined results: null roles and texts are one
space; a row's first fault counts, of blank, duplicate (role and text seen earlier), truncated; a null conv_id is one
conversation; an empty role has no initial and stands in no legal pair; without turns gaps are 0; an empty table gives an
empty result; columns of other names are ignored. Texts are taken whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, written
from helixmill.llm.mixing import summed_before

#: Places of a piece.
PIECE = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a; the state that an own or inserted user or assistant turn leads to.
STATES = range(4)
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Cost to go after the last row: empty turns lead to an end.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: Characters of a text that ranges of rows go by.
HEAD = 64
BLANK, REPEATED, TRUNCATED, SOUND = range(4)


def kept_state(state: int, initial: str) -> int | None:
    """Where a kept row leads."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def row_edits(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state, by letter: letter, cost, next state."""
    out, cut = [("D", DELETE, state)], CUT * (fault == TRUNCATED)
    if fault not in (BLANK, REPEATED):
        to = kept_state(state, initial)
        out += [("K", KEEP + cut, to)] if to is not None else []
        out.append(("R", REROLE + cut, NEXT[state]))
    return out


@functools.cache
def row_table(initial: str, fault: int) -> np.ndarray:
    """Least cost from state to state over a row, empty turns before it included."""
    table = np.full((4, 4), FAR, np.int64)
    for state in STATES:
        at, cost = state, 0
        for _ in range(4):  # after three inserts states come again
            for _, own, to in row_edits(at, initial, fault):
                table[state, to] = min(table[state, to], cost + own)
            at, cost = NEXT[at], cost + INSERT
    return table


@functools.lru_cache(100_000)
def before_row(after: tuple[int, ...], initial: str, fault: int) -> tuple[int, ...]:
    """Costs to go before a row from those after it."""
    return tuple(int(x) for x in (row_table(initial, fault) + np.array(after)).min(axis=1))


def walk(state: int, rows: list[tuple[str, int]], costs: list[tuple[int, ...]]) -> tuple[str, int]:
    """The edits from a state over rows (initial, fault) with the costs to go before each and after the last; the state then."""
    audit = []
    for i, (initial, fault) in enumerate(rows):
        while True:
            now, after = costs[i], costs[i + 1]
            tight = [(letter, False, to) for letter, own, to in row_edits(state, initial, fault) if own + after[to] == now[state]]
            if INSERT + now[NEXT[state]] == now[state]:
                tight.append(("I", True, NEXT[state]))
            letter, again, state = min(tight)
            audit.append(letter)
            if not again:
                break
    return "".join(audit), state


def endings(state: int) -> str:
    """Empty turns after the last row."""
    return "I" * (AT_END[state] // INSERT)


def placed(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows in the order of all conversations: at, conv_id, turn, role, text, initial, fault."""
    space = F.lit(" ")
    typed = conversations.select(*(F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")), F.lit(1).cast("bigint").alias("one"))
    # Two rows that differ past the head of their texts are put in order inside a range.
    ranged = scratch.write(typed.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(HEAD))).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.count("*").alias("n"))
    base = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("conv_id", "turn", "role", "text")
    own = ranged.withColumn("own", F.row_number().over(inside) - 1).join(F.broadcast(base), "range")  # a row for each range
    rows = scratch.write(own.select((F.col("base") + F.col("own")).alias("at"), "conv_id", "turn", "role", "text"))
    # The first of equal rows by their digest; only its place is joined back, a key of its own.
    firsts = rows.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~F.coalesce("new", F.lit(False)), REPEATED).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return scratch.write(rows.join(firsts, "at", "left").withColumn("initial", F.left("role", F.lit(1))).withColumn("fault", fault).drop("new"))


def by_piece(rows: DataFrame, *more: str) -> DataFrame:
    """The narrow columns of rows, each piece's together and in order."""
    narrow = rows.select(F.expr(f"at DIV {PIECE}").alias("segment"), "at", "conv_id", "turn", "initial", "fault", *more)
    return narrow.repartition("segment").sortWithinPartitions("segment", "at")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows whose first ``keys`` columns agree."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of rows."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def chunked(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made(held, schema)
            held = []
    yield made(held, schema)


INT, TEXT, INTS = pa.int64(), pa.string(), pa.list_(pa.int64())
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECES = pa.schema([("conv_id", INT), ("first", INT), ("segment", INT), ("costs", INTS), ("opens", TEXT), ("closes", TEXT), ("low", INT), ("high", INT), *((c, INT) for c in COUNTS)])
PIECES_DDL = "conv_id bigint, first bigint, segment bigint, costs array<bigint>, opens string, closes string, low bigint, high bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def legal(one: str, other: str) -> bool:
    """Whether two initials may stand side by side."""
    return one + other in ("su", "ua", "au") and len(one) == 1


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: the table of costs, and what its conversation's sums need."""

    def rows() -> Iterator[tuple]:
        for piece in grouped(((b.select(["segment", "conv_id", "at", "turn", "initial", "fault"])) for b in batches), 2):
            costs = row_table(*piece[0][4:])
            for row in piece[1:]:
                costs = np.minimum((costs[:, :, None] + row_table(*row[4:])[None]).min(axis=1), FAR)
            turns = [r[3] for r in piece if r[3] is not None]
            faults = [r[5] for r in piece]
            illegal = sum(not legal(a[4], b[4]) for a, b in zip(piece, piece[1:], strict=False))
            yield (piece[0][1], piece[0][2], piece[0][0], costs.ravel().tolist(), piece[0][4], piece[-1][4], min(turns, default=None), max(turns, default=None), faults.count(BLANK), faults.count(REPEATED), faults.count(TRUNCATED), illegal, len(set(turns)))

    return chunked(rows(), PIECES)


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, each conversation's last one first, to the costs to go after each: first, after."""

    def rows() -> Iterator[tuple]:
        conv, after = (), AT_END
        for batch in batches:
            for conv_id, first, costs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "first", "costs")), strict=True):
                if conv != (conv_id,):
                    conv, after = (conv_id,), AT_END
                yield first, list(after)
                after = tuple(int(x) for x in (np.array(costs).reshape(4, 4) + np.array(after)).min(axis=1))

    return chunked(rows(), pa.schema([("first", INT), ("after", INTS)]))


def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: first, and for each state to begin with the audit, the state at the end and the cost to go."""

    def rows() -> Iterator[tuple]:
        for piece in grouped(((b.select(["segment", "conv_id", "at", "initial", "fault", "after"])) for b in batches), 2):
            after = next(r[5] for r in piece if r[5] is not None)
            own = [r[3:5] for r in piece]
            costs = [tuple(after)]
            for row in reversed(own):
                costs.append(before_row(costs[-1], *row))
            costs.reverse()
            found = [walk(s, own, costs) for s in STATES]
            yield piece[0][2], [a for a, _ in found], [s for _, s in found], list(costs[0])

    return chunked(rows(), pa.schema([("first", INT), ("audits", pa.list_(TEXT)), ("ends", INTS), ("costs", INTS)]), 16)


TOTALS = ("gaps", *COUNTS[:4], "cost")
INFO = pa.schema([("conv_id", INT), ("first", INT), ("state", INT), ("audit", TEXT), ("last", pa.bool_()), *((c, INT) for c in TOTALS)])


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the walks that connect: state at the beginning, audit; the last one has the conversation's sums."""

    def closed(piece: dict | None, state: int, audit: str, begun: int, sums: dict, last: bool) -> tuple:
        low, high = sums["low"], sums["high"]
        gaps = 0 if low is None else high - low + 1 - sums["turns"]
        return (piece["conv_id"], piece["first"], begun, audit + (endings(state) if last else ""), last, gaps, *(sums[c] for c in (*COUNTS[:4], "cost")))

    def rows() -> Iterator[tuple]:
        held, sums, state, begun, audit = None, {}, 0, 0, ""
        for batch in batches:
            for piece in batch.to_pylist():
                same = held is not None and held["conv_id"] == piece["conv_id"]
                if held is not None:
                    yield closed(held, state, audit, begun, sums, not same)
                if not same:
                    state, sums = 0, {c: piece[c] for c in (*COUNTS, "low", "high")} | {"cost": piece["to_go"][0]}
                else:
                    for c in COUNTS[:4]:
                        sums[c] += piece[c]
                    sums["illegal"] += not legal(held["closes"], piece["opens"])
                    sums["turns"] += piece["turns"] - (piece["low"] is not None and piece["low"] == sums["high"])
                    sums["low"] = piece["low"] if sums["low"] is None else sums["low"]
                    sums["high"] = sums["high"] if piece["high"] is None else piece["high"]
                begun, audit, state, held = state, piece["audits"][state], piece["ends"][state], piece
        if held is not None:
            yield closed(held, state, audit, begun, sums, True)

    return chunked(rows(), INFO, 64)


INFO_DDL = "conv_id bigint, first bigint, state bigint, audit string, last boolean, " + ", ".join(f"{c} bigint" for c in TOTALS)


def plan(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Edits of all pieces, the last one of a conversation with its sums."""
    pieces = scratch.write(by_piece(rows).mapInArrow(summaries, PIECES_DDL))
    back = pieces.select("conv_id", "first", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"))
    to_go = scratch.write(back.mapInArrow(backward, "first bigint, after array<bigint>"))
    told = rows.join(to_go.withColumnRenamed("first", "at"), "at", "left")
    found = by_piece(told, "after").mapInArrow(walks, "first bigint, audits array<string>, ends array<bigint>, costs array<bigint>")
    chosen = pieces.drop("costs", "segment").join(found.withColumnRenamed("costs", "to_go"), "first")
    return scratch.write(chosen.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(forward, INFO_DDL))


def streamed(rows: DataFrame, info: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """``run`` over the rows of each conversation in order, before the first of each piece that piece's edits."""
    none = {c: F.lit(None).cast(dict(info.dtypes)[c]).alias(c) for c in info.columns}
    texts = rows.select("conv_id", "at", F.lit(1).alias("kind"), "turn", "role", "text", *(none[c] for c in info.columns if c not in ("conv_id", "first")))
    edits = info.select("conv_id", F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), *(c for c in info.columns if c not in ("conv_id", "first")))
    return texts.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").mapInArrow(run, ddl)


def repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict | None]]:
    """(conv_id, edit, turn, role, text) of what stays, in order, with None; after a conversation's last one its info row."""
    now, letters, state, closing = None, iter(()), 0, None

    def inserted() -> tuple:
        nonlocal state
        state = NEXT[state]
        return now, "I", None, ROLE[state], ""

    def trailing() -> Iterator[tuple]:
        for _ in letters:
            yield inserted(), None
        yield (now,), closing

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text")), range(batch.num_rows), strict=True):
            conv_id, kind, turn, role, text, i = row
            if kind == 0:
                if closing is not None:  # the last piece of the conversation before
                    yield from trailing()
                info = {c: batch.column(c)[i].as_py() for c in ("state", "audit", "last", *TOTALS)}
                now, letters, state, closing = conv_id, iter(info["audit"]), info["state"], info if info["last"] else None
                yield (now, info["audit"]), {"audit": info["audit"]}
                continue
            for letter in letters:
                if letter == "I":
                    yield inserted(), None
                    continue
                if letter == "K":
                    state = kept_state(state, role[:1])
                    yield (now, letter, turn, role, text), None
                elif letter == "R":
                    state = NEXT[state]
                    yield (now, letter, turn, ROLE[state], text), None
                break
    if closing is not None:
        yield from trailing()


REPORT = pa.schema([("conv_id", INT), *((c, INT) for c in TOTALS), ("audit", TEXT), ("repaired_sha256", TEXT)])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation."""

    def rows() -> Iterator[tuple]:
        audit, running, some = [], hashlib.sha256(), False
        for turn, info in repaired_turns(batches):
            if info is None:
                running.update(("\n" * some + f"{turn[3]}:{turn[4]}").encode())
                some = True
            elif len(turn) == 2:
                audit.append(turn[1])
            else:
                yield (turn[0], *(info[c] for c in TOTALS), "".join(audit), running.hexdigest())
                audit, running, some = [], hashlib.sha256(), False

    return chunked(rows(), REPORT, 500)


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    scratch = Scratch(conversations.sparkSession)
    rows = placed(conversations, scratch)
    ddl = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in TOTALS) + ", audit string, repaired_sha256 string"
    out = written(streamed(rows, plan(rows, scratch), digests, ddl))
    scratch.drop()
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (0, 1, ...), edit (K, R or I), turn (null if inserted), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            place = 0
            for turn, info in repaired_turns(batches):
                if info is None:
                    yield turn[0], place, *turn[1:]
                place = place + 1 if info is None else place if len(turn) == 2 else 0

        return chunked(rows(), pa.schema([("conv_id", INT), ("place", INT), ("edit", TEXT), ("turn", INT), ("role", TEXT), ("text", TEXT)]), 500)

    scratch = Scratch(conversations.sparkSession)
    rows = placed(conversations, scratch)
    out = written(streamed(rows, plan(rows, scratch), run, "conv_id bigint, place bigint, edit string, turn bigint, role string, text string"))
    scratch.drop()
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults put into conversations by the crc32 of ``conv_id:turn``, to be found and mended: conv_id, turn, role, text."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def damage_report(conversations: DataFrame) -> DataFrame:
    """``report`` of the damaged conversations, with a row for each original one; one without rows costs nothing."""
    found = report(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    joined = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    numbers = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("bigint").alias(c) for c in TOTALS]
    return joined.select(F.col("e.conv_id").alias("conv_id"), *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
