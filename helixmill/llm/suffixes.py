"""Operator 13, removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

The suffixes that start at sampled positions get ranks by growing prefixes, each rank a name for the pair of the rank
before and the rank at an offset, so that equal prefixes have equal ranks wherever they are. Positions whose rank is
theirs alone drop out; what is left at the threshold starts equal strings of ``SIZE`` bytes.

* A window is a string of ``SIZE`` bytes at one place. Of its first ``GAP`` grams of ``GRAM`` bytes, that of the least hash
  is its anchor, so equal windows have equal anchors. Neighbouring windows share an anchor and form a stretch. Anchors
  are the sampled positions, about two in ``GAP``; ranks of all positions would take a row for each byte and round.
* In a task, names of 2, 4, 8, 16 and 32 bytes are made by pairs at these offsets. The 32 bytes at an anchor lie in each of
  its windows. Spark sorts anchors by their rank; those alone drop out.
* Stretches of one rank whose whole bytes agree are settled at once: all but the first are repeated.
* What is left, one of each different stretch, is cut out of its text. Pairs of the rank with that at offset 32, and with
  that at offset -32, give 64 bytes; each window holds one of the two. Spark sorts the pairs; halves alone drop out.
* Windows of halves that are left are ranked by all their bytes, past which nothing is compared. All but the first of
  equal ones are repeated. Spark sorts the cuts by rank, and a task ranks the windows of one rank together; where over
  ``CROWD`` different stretches have one rank, their windows are rows that Spark sorts itself.

Ranks are hashes of 64 bits; windows are told apart by 96 and their anchor's rank. Each phase is a table in the shared
folder. Joins by rank are of plain shuffles, which Spark splits where very many places share a rank.

Defined results: a null or empty text has no bytes; order is by doc_id, a null doc_id last, then by place; rows with equal
doc_id and text are one document and get the same result, rows with equal doc_id (or none) and different texts are told
apart and ordered by a 64-bit hash of them; an empty table gives an empty result; columns of other names are ignored.
Texts are taken whole. What is kept of a text may end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, as_bytes, mix64, steps, written
from helixmill.llm.recompression import BROADCAST_INTS, BROADCAST_ROWS, keyed, powers

SIZE = 100
GRAM, DEPTH = 16, 32
#: Grams that a window's anchor is chosen of: all whose ``DEPTH`` bytes lie in the window.
GAP = SIZE - DEPTH + 1
#: The least distance from a window's start to its anchor with which it holds the ``DEPTH`` bytes before the anchor.
LEFT = 2 * DEPTH + GAP - SIZE
#: Bytes that are hashed at once; places in them take ``PLACE_BITS``.
CHUNK, PLACE_BITS = 1 << 18, 20
ODD = tuple(int(x) | 1 for x in mix64(np.arange(8, dtype=np.uint64), 300))
ROWS = "doc bigint, part bigint, start int, n int, ahead int"
PLACE = ("doc", "part", "start")
#: Different stretches of one rank that a task compares by itself.
CROWD = 4096
#: Numbers that tell of cuts are broadcast up to so many; they are rows of structs there.
CUT_NUMBERS = 250_000
#: Bytes of cuts that a task takes at once, beside those of one rank.
CUT_BYTES = 4 << 20


def paired(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """A name for each pair of names."""
    with np.errstate(over="ignore"):
        out = left * np.uint64(ODD[level])
        out ^= right * np.uint64(ODD[level + 1])
        out ^= out >> np.uint64(29)
        out *= np.uint64(ODD[level + 2])
        return out


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number: pairs at offsets 1, 2 and 4, which are their own names."""
    two = data.astype(np.uint16)
    two = two[:-1] | (two[1:] << np.uint16(8))
    four = two.astype(np.uint32)
    four = four[:-2] | (four[2:] << np.uint32(16))
    eight = four.astype(np.uint64)
    return eight[:-4] | (eight[4:] << np.uint64(32))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling too."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


@cache
def tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of a base, and of its inverse."""
    base = int(mix64(np.array([seed], np.uint64), 23)[0]) | 1
    return mix64(np.arange(256, dtype=np.uint64), seed), powers(base, size), powers(pow(base, -1, 2**64), size + 1)


class Bytes:
    """Hashes of any strings of a buffer."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        of_byte, power, self.inverse = tables(seed, CHUNK + 4 * SIZE if len(data) <= CHUNK + 4 * SIZE else 1 << int(len(data)).bit_length())
        self.seed, self.sums = seed, np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(of_byte[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One for each string from start to end (exclusive)."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64), self.seed)


def deep(eight: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Names of the ``DEPTH`` bytes at places: pairs at offsets 8 and 16."""
    sixteen = [paired(eight[place + i], eight[place + i + 8], 0) for i in (0, 16)]
    return paired(*sixteen, 3)


def chunk_stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a buffer of texts that end at ``ends``: start, windows, anchor (places in the buffer) and name of each stretch."""
    windows = len(data) - SIZE + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    eight = eights(data)
    order = paired(eight[:-8], eight[8:], 0)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    order &= ~mask
    order |= np.arange(len(order), dtype=np.uint64)
    anchor = (least_of(order, GAP)[:windows] & mask).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = text[:windows] == text[SIZE - 1 :]
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (text[1:windows] != text[: windows - 1])
    start = np.flatnonzero(begins)
    # A stretch ends before the next one, or with the last window of its text.
    n = np.minimum(np.append(start[1:], windows), ends[text[start]] - SIZE + 1) - start
    return start, n, anchor[start], deep(eight, anchor[start])


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about ``CHUNK`` bytes: the bytes, the ends of texts in them, and each one's row and first byte in its text.

    A longer text is cut with an overlap, so that each of its windows lies in one buffer.
    """
    held, rows, firsts, size = [], [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        out = np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(rows), np.array(firsts)
        held.clear(), rows.clear(), firsts.clear()
        return out

    for row, text in enumerate(texts):
        for first in range(0, max(len(text) - SIZE + 1, 0), CHUNK):
            piece = text[first : first + CHUNK + SIZE - 1]
            if held and size + len(piece) > CHUNK + SIZE - 1:
                yield made()
                size = 0
            held.append(piece)
            rows.append(row)
            firsts.append(first)
            size += len(piece)
    if held:
        yield made()


def signed(values: np.ndarray) -> pa.Array:
    """64-bit names as a bigint column."""
    return pa.array(values.view(np.int64))


def names(rows: DataFrame) -> DataFrame:
    """name and places: how many stretches of a step have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [chunk_stretches(data, ends)[3] for data, ends, _, _ in pieces(as_bytes(batch.column("text")))]
            name, places = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(name), pa.array(places)], ["name", "places"])

    return rows.select("text").mapInArrow(run, "name bigint, places bigint")


def stretches(rows: DataFrame) -> DataFrame:
    """name, span (hash of all bytes), doc, part, start, n (windows) and ahead (from start to anchor) of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for data, ends, row, first in pieces(as_bytes(batch.column("text"))):
                start, n, anchor, name = chunk_stretches(data, ends)
                owner = np.searchsorted(ends, start, "right")
                at = pa.array(row[owner])
                place = (start - (ends - np.diff(ends, prepend=0))[owner] + first[owner]).astype(np.int32)
                span = Bytes(data, 31).hashes(start, start + n + SIZE - 1)
                yield pa.RecordBatch.from_arrays(
                    [signed(name), signed(span), batch.column("doc").take(at), batch.column("part").take(at), pa.array(place), pa.array(n.astype(np.int32)), pa.array((anchor - start).astype(np.int32))],
                    ["name", "span", "doc", "part", "start", "n", "ahead"],
                )

    return rows.select("doc", "part", "text").mapInArrow(run, f"name bigint, span bigint, {ROWS}")


def few_ranges(listed: DataFrame, column: str, width: int, most: int = BROADCAST_INTS) -> bool:
    """Whether lists of ``width`` numbers an entry are small enough to broadcast."""
    size = listed.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("entries")).first()
    return size["rows"] <= BROADCAST_ROWS and size["entries"] * width <= most


def cuts(rows: DataFrame, owners: DataFrame, scratch: Scratch) -> DataFrame:
    """The bytes of chosen stretches: name, crowded, doc, part, start, n, ahead, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts, lists = as_bytes(batch.column("text")), batch.column("owned")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, n = (flat.field(c).to_numpy() for c in ("start", "n"))
            cut = [texts[o][s : s + k + SIZE - 1] for o, s, k in zip(owner.tolist(), start.tolist(), n.tolist(), strict=True)]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([flat.field("name"), flat.field("crowded"), batch.column("doc").take(at), batch.column("part").take(at), *(flat.field(c) for c in ("start", "n", "ahead")), pa.array(cut, pa.binary())], ["name", "crowded", "doc", "part", "start", "n", "ahead", "cut"])

    listed = scratch.write(owners.groupBy("doc", "part").agg(F.collect_list(F.struct("name", "crowded", "start", "n", "ahead")).alias("owned")))
    few = few_ranges(listed, "owned", 5, CUT_NUMBERS)
    joined = rows.select("doc", "part", "text").join(F.broadcast(listed) if few else listed, ["doc", "part"])
    found = joined.mapInArrow(run, f"name bigint, crowded boolean, {ROWS}, cut binary")
    repeated = not rows.groupBy("doc", "part").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()  # one document in several rows
    return scratch.write(found.dropDuplicates(list(PLACE)) if repeated else found)


def halves(cut: DataFrame) -> DataFrame:
    """name, before (the pair at offset -``DEPTH``; else at ``DEPTH``), pair, doc, part, start of each half that has windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "cut"):
            name, n, ahead = (batch.column(c).to_numpy() for c in ("name", "n", "ahead"))
            held = as_bytes(batch.column("cut"))
            begin = np.cumsum([0, *map(len, held[:-1])])
            eight, anchor = eights(np.frombuffer(b"".join(held), np.uint8)), begin + ahead
            own = name.view(np.uint64)
            out = []
            # Windows of a stretch have their anchor from ahead - n + 1 to ahead bytes after their start.
            for before, some, offset in ((False, ahead - n + 1 < LEFT, DEPTH), (True, ahead >= LEFT, -DEPTH)):
                at = np.flatnonzero(some)
                pair = paired(own[at], deep(eight, anchor[at] + offset), 5)
                take = pa.array(at)
                out.append([batch.column("name").take(take), pa.array(np.full(len(at), before)), signed(pair), *(batch.column(c).take(take) for c in ("doc", "part", "start"))])
            for arrays in out:
                yield pa.RecordBatch.from_arrays(arrays, ["name", "before", "pair", "doc", "part", "start"])

    return cut.select("name", "doc", "part", "start", "n", "ahead", "cut").mapInArrow(run, "name bigint, before boolean, pair bigint, doc bigint, part bigint, start int")


def open_windows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows in the halves of cuts that are left: row of the cut, start in its text, two hashes of the bytes."""
    n, ahead, start = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "ahead", "start"))
    after, before = (np.array(batch.column(c).to_pylist(), bool) for c in ("after", "before"))
    held = batch.column("cut").to_pylist()
    begin = np.cumsum([0, *map(len, held[:-1])])
    owner = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.flatnonzero(np.where(ahead[owner] - own >= LEFT, before[owner], after[owner]))
    owner, own = owner[keep], own[keep]
    data, place = np.frombuffer(b"".join(held), np.uint8), begin[owner] + own
    high, low = (Bytes(data, seed).hashes(place, place + SIZE) for seed in (41, 42))
    return owner, start[owner] + own, high, low >> np.uint64(32)


WINDOW = "doc bigint, part bigint, start int"


def windows(cut: DataFrame) -> DataFrame:
    """name, high, low (hash of the bytes), doc, part, start of the windows in the halves that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "cut"):
            owner, start, high, low = open_windows(batch)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column("name").take(at), signed(high), pa.array(low.astype(np.uint32).view(np.int32)), batch.column("doc").take(at), batch.column("part").take(at), pa.array(start.astype(np.int32))], ["name", "high", "low", "doc", "part", "start"])

    return cut.mapInArrow(run, f"name bigint, high bigint, low int, {WINDOW}")


def compared(cut: DataFrame) -> DataFrame:
    """doc, part, start and n of the runs of repeated windows of cuts, a rank's cuts in one task."""

    def settled(table: pa.Table) -> pa.RecordBatch:
        owner, start, high, low = open_windows(table)
        name, doc, part = (table.column(c).to_numpy()[owner] for c in ("name", "doc", "part"))
        order = np.lexsort((start, part, doc, low, high, name))
        same = np.ones(len(order), bool)
        for key in (name, high, low):
            same[1:] &= key[order[1:]] == key[order[:-1]]
        again = np.sort(order[same & (np.arange(len(order)) > 0)])
        owner, start = owner[again], start[again]
        opens = np.ones(len(again), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(opens)
        n = np.diff(np.append(first, len(again)))
        at = owner[first]
        return pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[at]) for c in ("doc", "part")), pa.array(start[first].astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "part", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in steps(batches, "cut", CUT_BYTES):
            held.append(batch)
            if sum(b.nbytes for b in held) < CUT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            names = table.column("name").to_numpy()
            whole = int(np.searchsorted(names, names[-1]))  # cuts are in order of their rank; the last one may go on
            if whole:
                yield settled(table.slice(0, whole).combine_chunks())
                held = table.slice(whole).to_batches()
        if held:
            yield settled(pa.Table.from_batches(held).combine_chunks())

    return cut.repartition("name").sortWithinPartitions("name").mapInArrow(run, f"{WINDOW}, n int")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (start, windows) to ranges of bytes (start, end, start, end, ...) that neither meet nor touch."""
    for batch in batches:
        out = []
        for found in batch.column("found"):
            start, n = (found.values.field(c).to_numpy() for c in ("start", "n"))
            order = np.argsort(start)
            start, end = start[order], np.maximum.accumulate((start + n + SIZE - 1)[order])
            cut = np.flatnonzero(start[1:] > end[:-1])
            out.append(np.stack([start[np.append(0, cut + 1)], end[np.append(cut, len(end) - 1)]], axis=1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(out, pa.list_(pa.int32()))], ["doc", "part", "ranges"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc, part, ranges (start, end, start, end, ...) of bytes that repeats cover, of the documents that have any."""
    rows, scratch, place = keyed(docs), Scratch(docs.sparkSession), F.struct(*PLACE)
    often = scratch.write(names(rows).groupBy("name").agg(F.sum("places").alias("places")).where("places > 1").select("name"))
    found = scratch.write(stretches(rows).join(often, "name"))
    groups = scratch.write(found.groupBy("name", "span").agg(F.min(place).alias("least"), F.min(F.struct(*PLACE, "n", "ahead")).alias("own"), F.count("*").alias("places")))
    later = found.join(groups.where("places > 1").select("name", "span", "least"), ["name", "span"]).where(place > F.col("least"))
    whole = scratch.write(later.select(*PLACE, "n"))
    scratch.drop(found)
    several = groups.groupBy("name").agg(F.count("*").alias("spans")).where("spans > 1").select("name", (F.col("spans") > CROWD).alias("crowded"))
    cut = cuts(rows, groups.join(several, "name").select("name", "crowded", "own.*"), scratch)
    sides = scratch.write(halves(cut))
    shared = sides.groupBy("name", "before", "pair").agg(F.count("*").alias("places")).where("places > 1").select("name", "before", "pair")
    left = sides.join(shared, ["name", "before", "pair"]).groupBy(*PLACE).agg(F.bool_or("before").alias("before"), F.bool_or(~F.col("before")).alias("after"))
    left = scratch.write(cut.join(left, list(PLACE)).select("name", "crowded", *PLACE, "n", "ahead", "cut", "after", "before"))
    scratch.drop(cut)
    settled = scratch.write(compared(left.where("NOT crowded")))
    rest = scratch.write(windows(left.where("crowded")))
    firsts = scratch.write(rest.groupBy("name", "high", "low").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("name", "high", "low", "least"))
    single = rest.join(firsts, ["name", "high", "low"]).where(place > F.col("least")).select(*PLACE, F.lit(1).alias("n")).unionByName(settled)
    listed = whole.unionByName(single).groupBy("doc", "part").agg(F.collect_set(F.struct("start", "n")).alias("found"))
    out = written(listed.mapInArrow(merged, "doc bigint, part bigint, ranges array<int>"))
    scratch.drop()
    return out


def kept_bytes(text: bytes, ranges: list[int] | None) -> bytes:
    """What stands outside the ranges."""
    if not ranges:
        return text
    edges = [0, *ranges, len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` kept (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            held, ranges = as_bytes(batch.column("text")), batch.column("ranges").to_pylist()
            kept = [kept_bytes(t, r) for t, r in zip(held, ranges, strict=True)]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(t) for t in held], pa.int64()),
                "n_removed": pa.array([len(t) - len(k) for t, k in zip(held, kept, strict=True)], pa.int64()),
                "n_spans": pa.array([len(r or ()) // 2 for r in ranges], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
            if texts:
                out["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    found = repeated_ranges(docs)
    joined = keyed(docs).join(F.broadcast(found) if few_ranges(found, "ranges", 1) else found, ["doc", "part"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts)
