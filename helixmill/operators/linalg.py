"""Sparse products as joins, and vector operations. Vectors are tables (isoform_id or kmer_id, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Triangles that a task of the next round takes.
FAN = 8


def spmv(x: DataFrame, theta: DataFrame) -> DataFrame:
    """X theta: kmer_id, value. ``theta``: isoform_id, value."""
    return x.join(theta, "isoform_id").groupBy("kmer_id").agg(F.sum(F.col("p") * F.col("value")).alias("value"))


def spmv_t(x: DataFrame, r: DataFrame) -> DataFrame:
    """X' r: isoform_id, value. ``r``: kmer_id, value."""
    return x.join(r, "kmer_id").groupBy("isoform_id").agg(F.sum(F.col("p") * F.col("value")).alias("value"))


def observed(x: DataFrame, y: DataFrame) -> DataFrame:
    """Entries of X whose k-mer was seen, with its count: kmer_id, isoform_id, p, y."""
    return x.select("kmer_id", "isoform_id", "p").join(y.where("y > 0").select("kmer_id", "y"), "kmer_id")


def over_all(df: DataFrame, aggregate: Column) -> Column:
    """An aggregate over all rows of ``df`` as a scalar subquery: partial sums, then one number, no task with all rows."""
    return df.agg(aggregate.alias("__whole")).scalar()


def share(df: DataFrame, values: Column) -> Column:
    """Values divided by their sum over all rows of ``df``."""
    return values / over_all(df, F.sum(values))


def normalised(v: DataFrame, value: str = "value") -> DataFrame:
    """A vector divided by its sum."""
    return v.withColumn(value, share(v, F.col(value)))


def exp_normalised(v: DataFrame, x: str, y: str, out: str = "value") -> DataFrame:
    """x * exp(y - max y), divided by the sum."""
    raised = v.withColumn("__e", F.col(x) * F.exp(F.col(y) - over_all(v, F.max(y))))
    return raised.withColumn(out, share(raised, F.col("__e"))).drop("__e")


def softmax(v: DataFrame, value: str = "value", out: str = "value") -> DataFrame:
    """Softmax of a vector."""
    return exp_normalised(v.withColumn("__one", F.lit(1.0)), "__one", value, out).drop("__one")


def softmax0(v: DataFrame, index: str, value: str = "value") -> DataFrame:
    """Softmax with a first element pinned to 0 in front of the others (index -1)."""
    first = v.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias(index), F.lit(0.0).alias(value))
    return softmax(v.select(F.col(index).cast("bigint").alias(index), value).unionByName(first), value)


def norms(v: DataFrame, value: str = "value") -> DataFrame:
    """One row: l1, l2, linf, least_positive."""
    x = F.col(value)
    return v.agg(F.sum(F.abs(x)).alias("l1"), F.sqrt(F.sum(x * x)).alias("l2"), F.max(F.abs(x)).alias("linf"), F.min(F.when(x > 0, x)).alias("least_positive"))


def dot(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: dot."""
    return a.select(key, F.col("value").alias("__a")).join(b.select(key, F.col("value").alias("__b")), key).agg(F.sum(F.col("__a") * F.col("__b")).alias("dot"))


def clipped(v: DataFrame, value: str = "value") -> DataFrame:
    """Values that aren't positive become a tenth of the least positive one."""
    least = over_all(v, F.min(F.when(F.col(value) > 0, F.col(value))))
    return v.withColumn(value, F.when(F.col(value) <= 0, least / 10).otherwise(F.col(value)))


ENTRY = "row bigint, at bigint, value double"


def _entries(block: np.ndarray, number: int) -> pa.RecordBatch:
    """What isn't 0 in the R of a block, whose rows are those of triangle ``number``."""
    r = np.linalg.qr(block, mode="r")
    i, at = np.nonzero(r)
    return pa.RecordBatch.from_arrays([pa.array(number * block.shape[1] + i), pa.array(at), pa.array(r[i, at])], ["row", "at", "value"])


def _triangles(rows: DataFrame, width: int) -> DataFrame:
    """A triangle for each partition of ``rows``, numbered like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, last = np.zeros((2 * width, width)), 0, None
        for batch in batches:
            row, at, value = (c.to_numpy() for c in batch.columns)
            if not len(row):
                continue
            place = filled - 1 + np.cumsum(np.append(last is None or row[0] != last, row[1:] != row[:-1]))
            while place[-1] >= 2 * width:  # a full block becomes its R, in front of the rows to come
                full = place < 2 * width
                np.add.at(block, (place[full], at[full]), value[full])
                block = np.vstack([np.linalg.qr(block, mode="r"), np.zeros((width, width))])
                place, at, value = place[~full] - width, at[~full], value[~full]
            np.add.at(block, (place, at), value)
            filled, last = int(place[-1]) + 1, row[-1]
        if filled:
            yield _entries(block[:filled], TaskContext.get().partitionId())

    return rows.sortWithinPartitions("row").mapInArrow(run, ENTRY)


def _joined(triangles: DataFrame, width: int) -> DataFrame:
    """A triangle for each ``FAN`` of those with successive numbers."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row, at, value = (table[c].to_numpy() for c in ("row", "at", "value"))
        own, place = np.unique(row, return_inverse=True)
        block = np.zeros((len(own), width))
        block[place, at] = value
        return pa.Table.from_batches([_entries(block, key[0].as_py())])

    return triangles.groupBy(F.floor(F.col("row") / (FAN * width)).alias("number")).applyInArrow(run, ENTRY)


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of a tall table with columns 0 .. width - 1, given by its entries: row, at, value.

    A row's entries must be in one partition; places that occur twice add up. Each task keeps the R of what it has read, in a
    block of twice as many rows as columns, and rounds of tasks put ``FAN`` of these together, until one is left.
    """
    parts, found, r = rows.rdd.getNumPartitions(), _triangles(rows, width), np.zeros((width, width))
    while parts > 1:
        parts, found = -(-parts // FAN), _joined(found, width)
    found = found.toArrow()
    row, at, value = (found[c].to_numpy() for c in ("row", "at", "value"))
    r[row, at] = value
    return r
