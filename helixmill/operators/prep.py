"""Preparing transcripts and quantification tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.bases import names_in, reads_per_transcript
from helixmill.operators.linalg import share


def clean(records: DataFrame, header: str = "header", sequence: str = "sequence", wanted: str = ", mRNA", least: int = 100) -> DataFrame:
    """Keeps records without N, whose header has ``wanted``, of ``least`` bases or more."""
    return records.where(~F.contains(F.col(sequence), F.lit("N")) & F.contains(F.col(header), F.lit(wanted)) & (F.length(sequence) >= least))


def clean_strict(records: DataFrame, name: str = "name", sequence: str = "sequence", least: int = 100) -> DataFrame:
    """Keeps records over ``least`` bases whose name has NM or XM."""
    return records.where((F.length(sequence) > least) & F.col(name).rlike("NM|XM"))


def without(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Records whose key isn't listed."""
    return records.join(ids.select(key).distinct(), key, "left_anti")


def unknown(quant: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Rows of the quantification whose transcript isn't there."""
    return quant.join(records.select(key).distinct(), key, "left_anti")


def check_known(quant: DataFrame, records: DataFrame, key: str) -> None:
    """Raises if the quantification names a transcript that isn't there."""
    if not unknown(quant, records, key).isEmpty():
        raise ValueError("the quantification names unknown transcripts")


def with_counts(records: DataFrame, quant: DataFrame, key: str, count: str) -> DataFrame:
    """Records with their read counts, 0 where the quantification has none."""
    return records.join(quant.select(key, count), key, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def planned_reads(records: DataFrame, width: str, fold: str) -> DataFrame:
    """Adds reads (20-fold coverage) and size (a quarter of reads times fold)."""
    reads = reads_per_transcript(F.col(width))
    return records.withColumn("reads", reads).withColumn("size", reads * F.col(fold) / 4)


def name_shares(headers: DataFrame, header: str = "header") -> DataFrame:
    """Transcript names found in headers: name, n, theta (share of all)."""
    counted = headers.select(F.explode(names_in(F.col(header))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return counted.withColumn("theta", share(counted, F.col("n")))


def beside(counted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Counts (key, n) beside true abundances (key, truth): key, n, theta (share of all counts), truth; 0 where either lacks a name."""
    both = counted.join(truth, key, "full").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("truth", F.lit(0.0)).alias("truth"))
    return both.select(key, "n", (F.col("n") / counted.agg(F.sum("n")).scalar()).alias("theta"), "truth")
