"""Operator 8, removal of repeated passages by recompression.

Rounds name word runs and pairs. A run of equal words gets the name of word and length; then, round after round, every
symbol falls to one of two sides by its name, and each left symbol followed by a right one becomes the name of the pair.
A name is a hash of what it stands for, so equal passages get equal interior symbols wherever they are, without a table
of names. For each symbol the context that fixed it is kept. A window of ``WINDOW`` words sees the symbols whose context
lies inside it; of these it picks one of the highest level with the least name, so equal windows pick equal symbols.
Windows that see none pick themselves.

Neighbouring windows that pick one occurrence of a symbol form a stretch. Stretches whose symbol was picked at two places
or more are compared by the hash of all their words: each but the first of equal ones is repeated whole. Where one symbol
has several different stretches, at the ends of a repeat, the windows of the first of each are hashed and compared one by
one. So the interior of a long repeat costs a row for each stretch and not for each window. Hashes have 96 bits or more.

Every phase is written to the shared folder before the next; the largest table goes as soon as it has been read, the
others when the removed ranges are known.

Defined results: a null or empty text has no words and nothing is removed; order is by doc_id, a null doc_id last, then
by place; rows with equal doc_id and text are one document and get the same result, rows with equal doc_id (or none)
and different texts are told apart and ordered by a 64-bit hash of them; an empty table gives an empty result; columns
of other names are ignored. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, as_bytes, mix64, steps, written
from helixmill.llm.shingles import word_hashes

WINDOW = 20
ROUNDS = 4
#: Ranges of removed words are broadcast up to so many documents and words of 4 bytes, beyond are joined by shuffle.
BROADCAST_ROWS, BROADCAST_INTS = 200_000, 2_000_000
LAST_ID = 2**63 - 1


class Substrings:
    """Hashes of any stretches of a sequence of word hashes, from running sums of a polynomial."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        base = int(mix64(np.array([seed], np.uint64), 17)[0]) | 1
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words, seed) * powers(base, len(words)), dtype=np.uint64)])
        self.inverse, self.seed = powers(pow(base, -1, 2**64), len(words) + 1), seed

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One for each stretch from start to end (exclusive)."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64), self.seed)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... mod 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def picks(words: np.ndarray, counts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbol that each window picks, its spot, the text and the first word (overall) of each window.

    Windows that pick one occurrence of a symbol have one spot.
    """
    within = Substrings(words, 50)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(text[: max(len(words) - window + 1, 0)] == text[window - 1 :]) if len(words) >= window else np.zeros(0, np.int64)
    text, place = text[whole] if len(whole) else np.zeros(0, np.int64), whole
    chosen, spot = within.hashes(place, place + window), -1 - place
    if not len(place):
        return chosen, spot, text, place
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin, end = (ends - counts)[doc], ends[doc]
    name, first, last = words.copy(), np.arange(len(words)), np.arange(len(words)) + 1
    # Runs: a word is single, or a run has its length, only where both neighbours are seen.
    starts = np.ones(len(words), bool)
    starts[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(starts)
    length = np.diff(np.append(at, len(words)))
    first, last = at - 1, at + length + 1  # begin - 1 and end + 1 at the ends of a text, which no window holds
    name, begin, end, doc = mix64(name[at] ^ mix64(length.astype(np.uint64), 60), 61), begin[at], end[at], doc[at]
    levels = []
    for level in range(1, rounds + 1):
        levels.append((name, first, last))
        right = (mix64(name, 70 + level) >> np.uint64(63)).astype(bool)
        same = doc[1:] == doc[:-1]
        joins = np.zeros(len(name), bool)
        joins[:-1] = ~right[:-1] & right[1:] & same
        joined = np.zeros(len(name), bool)
        joined[1:] = joins[:-1]
        after, before = np.append(last[1:], 0), np.append(0, first[:-1])
        with_next, with_last = np.append(same, False), np.append(False, same)
        new_last = np.where(joins, after, np.where(right, last, np.where(with_next, after, end + 1)))
        new_first = np.where(joins | ~right, first, np.where(with_last, before, begin - 1))
        with np.errstate(over="ignore"):
            pair = mix64(name * np.uint64(0x9E3779B97F4A7C15) + mix64(np.append(name[1:], name[:1]), 80 + level), 90 + level)
        keep = ~joined
        name, first, last = np.where(joins, pair, name)[keep], new_first[keep], new_last[keep]
        begin, end, doc = begin[keep], end[keep], doc[keep]
    levels.append((name, first, last))
    todo = np.arange(len(place))
    for level in range(rounds, -1, -1):
        name, first, last = levels[level]
        low = np.searchsorted(first, place[todo], "left")
        high = np.searchsorted(last, place[todo] + window, "right")
        rank = mix64(name, 99)
        seen = high > low
        done, low, high = todo[seen], low[seen], high[seen]
        best, best_rank = low.copy(), rank[low]
        for k in range(1, int((high - low).max()) if len(low) else 0):
            inside = np.flatnonzero(low + k < high)
            other = low[inside] + k
            better = rank[other] < best_rank[inside]
            best[inside[better]], best_rank[inside[better]] = other[better], rank[other[better]]
        # The words that fixed a symbol lie in the window too, so its name may take them in.
        chosen[done], spot[done] = mix64(name[best] ^ within.hashes(first[best], last[best]), level), best * (rounds + 1) + level
        todo = todo[~seen]
        if not len(todo):
            break
    return chosen, spot, text, place


def keyed(docs: DataFrame) -> DataFrame:
    """doc (order key), part (hash of the text, another one where there is no doc_id), text, and doc_id as it is."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("part"), "text")


def openings(chosen: np.ndarray, spot: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a window opens a stretch.

    Equal windows in a row, inside a long run of one word, pick themselves; the first is a stretch and the others are
    one more, so that they meet each other.
    """
    again = np.append(False, (spot[1:] < 0) & (spot[:-1] < 0) & (chosen[1:] == chosen[:-1]) & (text[1:] == text[:-1]))
    same = np.append(False, (spot[1:] == spot[:-1]) & (text[1:] == text[:-1]))
    second = again & ~np.append(False, again[:-1])
    return ~(same | again) | second


def stretches(rows: DataFrame, window: int) -> DataFrame:
    """name, span (hash of all words), doc, part, start (first word in its text) and n (windows) of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, counts = word_hashes(as_bytes(batch.column("text")), lower=False)
            chosen, spot, text, place = picks(words, counts, window)
            if not len(chosen):
                continue
            first = np.flatnonzero(openings(chosen, spot, text))
            n = np.diff(np.append(first, len(spot)))
            begin, owner = place[first], text[first]
            span = Substrings(words, 200).hashes(begin, begin + n + window - 1)
            start = (begin - (np.cumsum(counts) - counts)[owner]).astype(np.int32)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(chosen[first].view(np.int64)), pa.array(span.view(np.int64)), batch.column("doc").take(at), batch.column("part").take(at), pa.array(start), pa.array(n.astype(np.int32))], ["name", "span", "doc", "part", "start", "n"])

    return rows.select("doc", "part", "text").mapInArrow(run, "name bigint, span bigint, doc bigint, part bigint, start int, n int")


def shared(every: DataFrame, scratch: Scratch) -> DataFrame:
    """Stretches whose symbol was picked at two places or more.

    The symbols are written first: a join of two plain shuffles lets Spark split a symbol that very many places share.
    """
    often = scratch.write(every.groupBy("name").agg(F.count("*").alias("places")).where("places > 1").select("name"))
    return scratch.write(every.join(often, "name"))


def windows_of(rows: DataFrame, owners: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """The windows of chosen stretches: high, low (hash of the words), doc, part, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, counts = word_hashes(as_bytes(batch.column("text")), lower=False)
            high, low = Substrings(words, 300), Substrings(words, 400)
            lists = batch.column("owned")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            owner, start = np.repeat(owner, n), np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place = start + (np.cumsum(counts) - counts)[owner]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(high.hashes(place, place + window).view(np.int64)), pa.array((low.hashes(place, place + window) >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column("doc").take(at), batch.column("part").take(at), pa.array(start.astype(np.int32))],
                ["high", "low", "doc", "part", "start"],
            )

    listed = scratch.write(owners.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n")).alias("owned")))
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (listed.agg(F.sum(F.size("owned"))).first()[0] or 0) <= BROADCAST_INTS // 2
    joined = rows.select("doc", "part", "text").join(F.broadcast(listed) if few else listed, ["doc", "part"])
    return scratch.write(joined.mapInArrow(run, "high bigint, low int, doc bigint, part bigint, start int"))


def repeats(rows: DataFrame, found: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Ranges of words that repeats cover: doc, part, ranges (start, end, start, end, ...). ``found``: shared stretches."""
    place = F.struct("doc", "part", "start")
    groups = scratch.write(found.groupBy("name", "span").agg(F.min(place).alias("least"), F.max("n").alias("n"), F.count("*").alias("places")))
    later = found.join(groups.where("places > 1").select("name", "span", "least"), ["name", "span"]).where(place > F.col("least")).select("doc", "part", "start", "n")
    several = groups.groupBy("name").agg(F.count("*").alias("spans")).where("spans > 1").select("name")
    owners = groups.join(several, "name").select("least.*", "n")
    windows = windows_of(rows, owners, window, scratch)
    first = scratch.write(windows.groupBy("high", "low").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("high", "low", "least"))
    single = windows.join(first, ["high", "low"]).where(place > F.col("least")).select("doc", "part", "start", F.lit(1).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs in batch.column("found").to_pylist():
                at = np.array(sorted((x["start"], x["start"] + x["n"] + window - 1) for x in pairs), np.int32)
                reach = np.maximum.accumulate(at[:, 1])
                cut = np.flatnonzero(at[1:, 0] > reach[:-1])
                out.append(np.stack([at[np.append(0, cut + 1), 0], np.append(reach[cut], reach[-1])], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(out, pa.list_(pa.int32()))], ["doc", "part", "ranges"])

    listed = later.unionByName(single).groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    return written(listed.mapInArrow(run, "doc bigint, part bigint, ranges array<int>"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, part, ranges of the documents that lose words."""
    rows, scratch = keyed(docs), Scratch(docs.sparkSession)
    every = scratch.write(stretches(rows, window))
    found = shared(every, scratch)
    scratch.drop(every)
    out = repeats(rows, found, window, scratch)
    scratch.drop()
    return out


def attached(docs: DataFrame, window: int) -> DataFrame:
    """The keyed documents with their ranges (null without)."""
    found = repeated_ranges(docs, window)
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("ranges")), F.lit(0)).alias("ints")).first()
    if size["rows"] <= BROADCAST_ROWS and size["ints"] <= BROADCAST_INTS:
        found = F.broadcast(found)
    return keyed(docs).join(found, ["doc", "part"], "left").select("doc_id", "text", "ranges")


def kept_words(text: bytes, ranges: list[int] | None) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those outside the ranges."""
    words = text.split()
    if not ranges:
        return len(words), words
    kept, at = [], 0
    for start, end in zip(ranges[::2], ranges[1::2], strict=True):
        kept += words[at:start]
        at = end
    return len(words), kept + words[at:]


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``texts`` kept_text (words, one space apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [kept_words(t, r) for t, r in zip(as_bytes(batch.column("text")), batch.column("ranges").to_pylist(), strict=True)]
            kept = [b" ".join(w) for _, w in rows]
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array([n for n, _ in rows], pa.int64()), "n_removed": pa.array([n - len(w) for n, w in rows], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
            if texts:
                out["kept_text"] = pa.array([k.decode("utf-8", "replace") for k in kept])
            yield pa.RecordBatch.from_pydict(out)

    return attached(docs, window).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)
