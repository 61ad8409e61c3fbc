"""K-mer counts (y) and their summaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.bases import check_k, uniform
from helixmill.operators.shred import code_of, shred, spanning_blocks, spread


def kmer_counts(reads: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    """Sparse counts over all reads: kmer_id, y. K-mers never span reads; absent ones count 0.

    Counted as strings with map-side combine; only distinct k-mers are turned into integers.
    """
    return shred(spread(reads.select(sequence)), k, sequence).groupBy("kmer").agg(F.count("*").alias("y")).select(code_of(F.col("kmer")).alias("kmer_id"), "y")


def spanning_counts(reads: DataFrame, k: int, file: str = "file", order: str = "seq_idx", sequence: str = "sequence") -> DataFrame:
    """Counts over the reads of each file joined in order, so that k-mers span reads: kmer_id, y."""
    return kmer_counts(spanning_blocks(reads, k, file, order, sequence), k, sequence)


def zero_filled(counts: DataFrame, k: int) -> DataFrame:
    """All 4^k codes with their counts, 0 where absent; only for short k-mers."""
    space = counts.sparkSession.range(4 ** check_k(k)).withColumnRenamed("id", "kmer_id")
    return space.join(counts, "kmer_id", "left").select("kmer_id", F.coalesce("y", F.lit(0)).cast("bigint").alias("y"))


def total(counts: DataFrame) -> DataFrame:
    """One row: n, the sum of counts."""
    return counts.agg(F.sum("y").cast("bigint").alias("n"))


def density(reads: DataFrame, ks: list[int], sequence: str = "sequence") -> DataFrame:
    """For each k: nnz (distinct k-mers) and density (nnz / 4^k)."""
    parts = [kmer_counts(reads, k, sequence).agg(F.count_if(F.col("y") > 0).alias("nnz")).select(F.lit(k).alias("k"), "nnz", (F.col("nnz") / float(4**k)).alias("density")) for k in ks]
    return reduce(DataFrame.unionByName, parts)


#: Distribution function of the Poisson law with mean 1, up to where a double reaches 1.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(18)]


def bootstrap_counts(reads: DataFrame, k: int, replicates: int, seed: int, key: tuple[str, ...], sequence: str = "sequence") -> DataFrame:
    """Counts of resampled reads: replicate, kmer_id, y.

    Each read stands a Poisson number of times in each replicate, drawn from a hash of its key, so no replicate needs
    the number of reads and a lost task draws the same again.
    """
    drawn = reads.select(*key, sequence).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = uniform(seed, F.col("replicate"), *map(F.col, key))
    times = reduce(lambda a, b: a + b, [(u >= limit).cast("bigint") for limit in POISSON])
    drawn = drawn.withColumn("times", times).where("times > 0")
    summed = shred(spread(drawn), k, sequence, ("replicate", "times")).groupBy("replicate", "kmer").agg(F.sum("times").alias("y"))
    return summed.select("replicate", code_of(F.col("kmer")).alias("kmer_id"), "y")
