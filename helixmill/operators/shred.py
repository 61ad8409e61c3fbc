"""Sequences to k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from helixmill.functions.bases import BASES, DIGITS, check_k, encode, is_valid
from helixmill.operators.order import running

#: Bases by byte, 4 for all else.
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(4)
#: Bytes of sequences that ``row_counts`` takes at once.
STEP = 1 << 20
#: Characters of a chunk. Substring walks a string from its start, so long runs are cut first, in one pass.
CHUNK = 128


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores if the input has fewer partitions than that; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _chunks(run: Column, k: int) -> Column:
    """A run in chunks that overlap by k - 1, so that each window of k lies in one."""
    size = max(CHUNK, k)
    blocks = F.transform(F.array(F.regexp_extract_all(run, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))), lambda cut: F.transform(cut, lambda c, i: F.concat(c, F.coalesce(F.left(F.get(cut, i + 1), F.lit(k - 1)), F.lit("")))))
    return F.when(F.length(run) <= size, F.array(run)).otherwise(F.get(blocks, F.lit(0)))


def _chunk_size(k: int) -> int:
    return max(CHUNK, k)


def _windows(chunk: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(chunk) - (k - 1)), lambda i: F.substr(chunk, i, F.lit(k)))


def shred(df: DataFrame, k: int, sequence: str = "sequence", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each valid k-mer: ``keep`` and kmer, as digits 0 to 3 (``code_of`` makes the integer).

    Valid runs are split off first, since a valid k-mer crosses no invalid character. A null sequence has none.
    """
    check_k(k)
    runs = df.select(*keep, F.explode(F.split(sequence, f"[^{BASES}]+")).alias("__run"))
    runs = runs.where(F.length("__run") >= k).select(*keep, F.translate("__run", BASES, DIGITS).alias("__run"))
    chunks = runs.select(*keep, F.explode(_chunks(F.col("__run"), k)).alias("__chunk")).where(F.length("__chunk") >= k)
    return chunks.select(*keep, F.explode(_windows(F.col("__chunk"), k)).alias("kmer"))


def tallied(data: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of each valid k-mer of rows of so many bytes, which lie in ``data`` one after the other."""
    codes, row = CODES[data], np.repeat(np.arange(len(sizes)), sizes)
    windows = max(len(codes) - k + 1, 0)
    code = np.zeros(windows, np.int64)
    for i in range(k):
        code = (code << 2) | (codes[i : i + windows] & 3)
    bad = np.append(0, np.cumsum(codes == 4, dtype=np.int32))
    valid = (bad[k:] == bad[:windows]) & (row[k - 1 :] == row[:windows]) if windows else np.zeros(0, bool)
    code, row = code[valid], row[:windows][valid]
    if len(sizes) * 4**k <= max(len(data), 1 << 16):
        n = np.bincount(row * 4**k + code, minlength=1)
        found = np.flatnonzero(n)
        return found >> 2 * k, found & (4**k - 1), n[found]
    own, place = np.unique(code, return_inverse=True)
    found, n = np.unique(row * len(own) + place, return_counts=True)
    return found // max(len(own), 1), own[found % max(len(own), 1)], n


def cut_rows(sizes: np.ndarray, k: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """Steps over rows of so many bytes: the rows' range, and the bytes' range in a row that is longer than a step."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")))
        for cut in range(0, max(int(sizes[at]) - k + 1, 1), step) if end == at + 1 else (0,):
            yield at, end, cut, cut + step + k - 1
        at = end


def row_counts(df: DataFrame, k: int, sequence: str, key: str) -> DataFrame:
    """``key``, kmer_id and cnt of the valid k-mers of each row; a row longer than a step may have a k-mer several times.

    Counted in numpy from the bytes of an Arrow column; all bytes of a character outside ACGT are invalid.
    """
    check_k(k)
    step = STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for first, last, start, end in cut_rows(np.diff(offsets), k, step):
                a, b = (offsets[first], offsets[last]) if last > first + 1 else (offsets[first] + start, min(offsets[first] + end, offsets[last]))
                sizes = np.diff(offsets[first : last + 1]) if last > first + 1 else np.array([b - a])
                row, code, n = tallied(data[a:b], sizes, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(code), pa.array(n.astype(np.int64))], [key, "kmer_id", "cnt"])

    out = StructType([df.select(key).schema[0]]).add("kmer_id", LongType()).add("cnt", LongType())
    return df.select(key, sequence).mapInArrow(run, out)


def code_of(digits: Column) -> Column:
    """Integer of a digit string from ``shred``."""
    return F.conv(digits, 4, 10).cast("bigint")


def shred_positions(df: DataFrame, k: int, sequence: str = "sequence", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, position (0-based) and kmer_id of each valid k-mer."""
    check_k(k)
    long = df.where(F.length(sequence) >= k)
    chunks = long.select(*keep, F.posexplode(_chunks(F.col(sequence), k)).alias("__c", "__chunk")).where(F.length("__chunk") >= k)
    windows = chunks.select(*keep, "__c", F.posexplode(_windows(F.col("__chunk"), k)).alias("__i", "__kmer"))
    valid = windows.where(is_valid(F.col("__kmer"), k))
    return valid.select(*keep, (F.col("__c") * _chunk_size(k) + F.col("__i")).cast("bigint").alias("position"), encode(F.col("__kmer")).alias("kmer_id"))


def reads_of(df: DataFrame, length: int, sequence: str = "sequence", keep: tuple[str, ...] = ()) -> DataFrame:
    """All windows of a read's length, valid or not: ``keep``, position, read."""
    long = df.where(F.length(sequence) >= length)
    chunks = long.select(*keep, F.posexplode(_chunks(F.col(sequence), length)).alias("__c", "__chunk")).where(F.length("__chunk") >= length)
    windows = chunks.select(*keep, "__c", F.posexplode(_windows(F.col("__chunk"), length)).alias("__i", "read"))
    return windows.select(*keep, (F.col("__c") * _chunk_size(length) + F.col("__i")).cast("bigint").alias("position"), "read")


def shred_pairs(df: DataFrame, k: int, first: str, second: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """K-mers of both reads of a pair, each read shredded by itself."""
    one = df.select(*keep, F.explode(F.array(first, second)).alias("sequence"))
    return shred(one, k, "sequence", keep)


#: Characters of a block of joined records.
BLOCK = 1 << 16


def spanning_blocks(records: DataFrame, k: int, file: str, order: str, sequence: str = "sequence", block: int = BLOCK) -> DataFrame:
    """The records of each file joined in order, cut into blocks that overlap by k - 1: file, sequence.

    Each window of k of the joined text lies in one block, so nothing holds a whole file. ``order`` tells the records of
    a file apart. Places are running sums of lengths; a record gives a piece to each block that it reaches into.
    """
    text = F.coalesce(F.col(sequence), F.lit(""))
    placed = running(records.select(file, order, F.length(text).cast("bigint").alias("__n")), [file, order], "__n", "__at")
    whole = records.select(file, order, text.alias("__s")).join(placed, [file, order]).where("__n > 0")
    first, last = F.greatest(F.lit(0), F.floor((F.col("__at") - (k - 1)) / block)), F.floor((F.col("__at") + F.col("__n") - 1) / block)
    reached = whole.withColumn("__b", F.explode(F.sequence(first, last)))
    start, end = F.greatest(F.col("__b") * block, F.col("__at")), F.least((F.col("__b") + 1) * block + (k - 1), F.col("__at") + F.col("__n"))
    piece = F.substr("__s", (start - F.col("__at") + 1).cast("int"), (end - start).cast("int"))
    pieces = reached.select(file, "__b", F.struct(start.alias("at"), piece.alias("piece")).alias("__p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("__p")), lambda p: p["piece"]), "")
    return pieces.groupBy(file, "__b").agg(joined.alias(sequence)).select(file, sequence)
