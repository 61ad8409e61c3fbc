"""K-mer counts by minimisers: neighbouring k-mers that share one travel as a single string.

The minimiser of a k-mer is the m-mer inside it whose hash is least. Windows in a row with one minimiser make a run (a
super-k-mer) of k + n - 1 bases, which is shuffled once, under its minimiser, in place of n k-mers. All occurrences of a
k-mer meet under its minimiser, so windows are cut out and counted where the runs lie, without another shuffle.

A few minimisers, such as those of low-complexity runs, may hold a large share of all windows. Those with more than their
part of a shuffle partition are counted beside the others as plain k-mers, summed in each batch before they are shuffled.

Partitions are as many as the windows need, so that the table of counts that a task holds doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.bases import DIGITS, check_k
from helixmill.operators.shred import CODES, code_of, spread
from helixmill.session import written

#: Length of a minimiser at most, else half of k: long enough that few k-mers share one, short enough that runs are long.
LENGTH = 9
#: Windows of a run at most; a longer one is cut, so that no row and no cut of it is long.
WINDOWS = 128
#: Bases that a task takes at once.
STEP = 1 << 20
#: A minimiser with fewer windows than this is never counted apart.
LEAST_HOT = 100_000
#: Windows that a task counts, on average.
TASK = 1 << 20
DIGIT = np.full(5, ord("."), np.uint8)
DIGIT[:4] = np.frombuffer(DIGITS.encode(), np.uint8)
#: An odd number, a fixed value, that spreads codes over 64 bits.
SPREAD = 0x9E3779B97F4A7C15


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from those of half as many."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of(text: bytes, k: int, m: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Runs of a text (bases, all else invalid), as digits; the code of each one's minimiser; its windows."""
    codes = CODES[np.frombuffer(text, np.uint8)]
    windows = len(codes) - k + 1
    if windows <= 0:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes == 4)])
    valid = bad[k:] == bad[:-k]
    mers = np.zeros(len(codes) - m + 1, np.uint64)
    for i in range(m):
        mers = (mers << np.uint64(2)) | (codes[i : i + len(mers)] & 3).astype(np.uint64)
    with np.errstate(over="ignore"):
        order = mers * np.uint64(SPREAD)  # odd, so that each m-mer keeps a value of its own
    least = sliding_least(order, k - m + 1)[:windows]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(begins)
    # A run ends before the next one, or where windows stop being valid.
    gaps = np.append(np.flatnonzero(~valid), windows)
    end = np.minimum(np.append(start[1:], windows), gaps[np.searchsorted(gaps, start)]) if len(start) else start
    parts = -(-(end - start) // WINDOWS)
    owner = np.repeat(np.arange(len(start)), parts)
    first = start[owner] + WINDOWS * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    n = np.minimum(end[owner] - first, WINDOWS)
    digits = DIGIT[codes].tobytes().decode("ascii")
    inverse = np.uint64(pow(SPREAD, -1, 2**64))
    with np.errstate(over="ignore"):
        code = (least[first] * inverse).view(np.int64)
    return [digits[a : a + b + k - 1] for a, b in zip(first.tolist(), n.tolist(), strict=True)], code, n


def minimiser_runs(reads: DataFrame, k: int, m: int | None = None, sequence: str = "sequence") -> DataFrame:
    """minimiser (its code), run (digits) and windows of all reads. No run spans two reads; null reads have none."""
    check_k(k)
    m = min(m or min(LENGTH, max(k // 2, 1)), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= STEP):
                    size += len(texts[upto])
                    upto += 1
                # Reads are joined by a line feed, which no k-mer holds; a long one is cut with an overlap.
                text = b"\n".join(texts[at:upto])
                for cut in range(0, max(len(text) - k + 1, 1), STEP):
                    runs, code, n = runs_of(text[cut : cut + STEP + k - 1], k, m)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(runs, pa.string()), pa.array(n)], ["minimiser", "run", "windows"])
                at = upto

    return spread(reads.select(sequence)).mapInArrow(run, "minimiser bigint, run string, windows bigint")


def cut_windows(runs: DataFrame, k: int) -> DataFrame:
    """minimiser and kmer (digits) of each window."""
    return runs.select("minimiser", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - (k - 1)), lambda i: F.substr("run", i, F.lit(k)))).alias("kmer"))


def hot_minimisers(runs: DataFrame, parts: int | None = None) -> dict[int, int]:
    """Those with more windows than a partition has on average, so fewer than partitions, and their windows."""
    parts = parts or int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = runs.groupBy("minimiser").agg(F.sum("windows").alias("windows"))
    total = runs.agg(F.sum("windows")).first()[0] or 0
    return {r["minimiser"]: r["windows"] for r in sums.where(F.col("windows") > max(LEAST_HOT, total // parts)).collect()}


def window_sums(runs: DataFrame, k: int) -> DataFrame:
    """kmer_id and y of runs, summed in each Arrow batch alone, so that a k-mer may have many rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = np.frombuffer("\n".join(batch.column(0).to_pylist()).encode(), np.uint8).astype(np.int64) - ord("0")
            windows = max(len(digits) - k + 1, 0)
            code = np.zeros(windows, np.int64)
            for i in range(k):
                code = (code << 2) | (digits[i : i + windows] & 3)
            ends = np.concatenate([[0], np.cumsum(digits < 0)])
            found, y = np.unique(code[ends[k:] == ends[:-k]] if windows else code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(y.astype(np.int64))], ["kmer_id", "y"])

    return runs.select("run").mapInArrow(summed, "kmer_id bigint, y bigint")


def counts_by_minimiser(reads: DataFrame, k: int, m: int | None = None, sequence: str = "sequence") -> DataFrame:
    """kmer_id and y of all reads, like ``kmer_counts``; for long k a fraction of its shuffle."""
    runs = written(minimiser_runs(reads, k, m, sequence))
    session = runs.sparkSession
    needed = -(-(runs.agg(F.sum("windows")).first()[0] or 0) // TASK)
    hot = hot_minimisers(runs, max(needed, int(session.conf.get("spark.sql.shuffle.partitions"))))
    apart = F.col("minimiser").isin(list(hot)) if hot else F.lit(False)
    # Grouping by (minimiser, kmer) is served by the partitioning on minimiser. The number is given, since adaptive
    # execution would join partitions by their bytes, and runs of few bytes have many windows.
    placed = cut_windows(runs.where(~apart).select("minimiser", "run").repartition(max(needed, session.sparkContext.defaultParallelism), "minimiser"), k)
    found = placed.groupBy("minimiser", "kmer").agg(F.count("*").alias("y")).select(code_of(F.col("kmer")).alias("kmer_id"), "y")
    if hot:
        parts = max(-(-sum(hot.values()) // TASK), session.sparkContext.defaultParallelism)
        found = found.unionByName(window_sums(runs.where(apart), k).repartition(parts, "kmer_id").groupBy("kmer_id").agg(F.sum("y").alias("y")))
    return found
