"""What the operators of this subpackage share: reading tables, the shared folder, Arrow batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Ranges of a table's order at most: their cuts come from one sketch and go to all tasks.
MOST_RANGES = 16_384
#: Code points that one step of a Python worker takes at once; a longer text makes a step of its own.
STEP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session without that setting (a local test) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='helixmill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/helixmill-{uuid.uuid4().hex}"


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that go as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame | None, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` after a round trip through Parquet in the shared folder: short lineage, computed once."""
        path = shared_dir(self.spark)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all."""
        gone = [path for table, path in self.held if not tables or any(table is x for x in tables)]
        self.held = [(table, path) for table, path in self.held if path not in gone]
        delete(self.spark, gone)


#: Tables that results still read; they go when the interpreter ends, or by ``release`` once results have been taken.
RESULTS: list[Scratch] = []


def written(df: DataFrame) -> DataFrame:
    """Like ``Scratch.write``, for tables that a result reads."""
    if not RESULTS or RESULTS[-1].spark is not df.sparkSession:
        RESULTS.append(Scratch(df.sparkSession))
    return RESULTS[-1].write(df)


def result_dir(spark: SparkSession) -> str:
    """A new folder for files that a result reads; it goes like the tables of ``written``."""
    path = shared_dir(spark)
    if not RESULTS or RESULTS[-1].spark is not spark:
        RESULTS.append(Scratch(spark))
    RESULTS[-1].held.append((None, path))
    return path


def release() -> None:
    """Deletes the tables and files behind all results so far, which can't be read any more, except of stopped sessions."""
    while RESULTS:
        scratch = RESULTS.pop()
        if scratch.spark.sparkContext._jsc is not None:
            scratch.drop()


@atexit.register
def _release_at_exit() -> None:
    with contextlib.suppress(Py4JError):  # the JVM may be gone already
        release()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Values of a string column; null is empty, bytes that are not UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in as_bytes(column)]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each hold about ``size`` bytes at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser over uint64 values (the splitmix64 constants are fixed values)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes that a memo's generation holds at most, unless its operator says otherwise.
MEMO_BYTES = 64 << 20
#: About what an entry takes beside its key and value.
ENTRY_BYTES = 100


class Memo(dict):
    """A memo of ``compute`` bounded by bytes: two generations, so that what is in use survives when one is full.

    A Python worker serves one stage after another; ``alone`` empties the memos that earlier stages have left in it.
    """

    every: ClassVar[list[Memo]] = []

    def __init__(self, compute: Callable, size: int = MEMO_BYTES, longest: int = 64) -> None:
        super().__init__()
        Memo.every.append(self)
        self.compute, self.size, self.longest, self.old, self.held = compute, size, longest, {}, 0

    def alone(self) -> Memo:
        """This memo, the others emptied."""
        for memo in Memo.every:
            if memo is not self and (memo or memo.old):
                memo.clear()
                memo.old, memo.held = {}, 0
        return self

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if self.held >= self.size:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += sys.getsizeof(key) + sys.getsizeof(value) + ENTRY_BYTES
            self[key] = value
        return value


def by_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names; columns of other names don't get in the way."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def quantiles(df: DataFrame, column: str, ranges: int) -> list[int]:
    """Upper ends of all but the last of about equal ranges of a long column, ``MOST_RANGES`` at most; nulls aside."""
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"]
    return sorted(set(found or []))


def free_prefix(columns: list[str]) -> str:
    """A run of underscores that none of the names begins with, for columns of one's own beside them."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
