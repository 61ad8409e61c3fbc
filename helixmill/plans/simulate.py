"""De Bruijn sequences, abundance draws and simulated reads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.bases import effective_length, uniform
from helixmill.operators.matrix import keep_records
from helixmill.operators.sampling import draw, draws


def de_bruijn(k: int, alphabet: str = "ACTG") -> str:
    """A linear sequence that holds each word of length ``k`` once: Lyndon words whose length divides k, then its first k - 1."""
    n, out, word = len(alphabet), [], [-1]
    while word:
        word[-1] += 1
        if k % len(word) == 0:
            out += word
        m = len(word)
        while len(word) < k:
            word.append(word[-m])
        while word and word[-1] == n - 1:
            word.pop()
    cycle = "".join(alphabet[i] for i in out)
    return cycle + (cycle * (k // len(cycle) + 1))[: k - 1]


def dirichlet(size: int, alpha: float, seed: int = 42) -> np.ndarray:
    """One draw of a symmetric Dirichlet distribution."""
    return np.random.default_rng(seed).dirichlet(np.full(size, alpha))


def sampled_reads(isoforms: DataFrame, theta: DataFrame, n: int, read_length: int, seed: int = 42) -> DataFrame:
    """``n`` reads: draw, isoform_id, start, read. ``isoforms``: isoform_id, sequence; ``theta``: isoform_id, value.

    Each read draws an isoform by theta and a start uniformly among its effective length. Numbers come from hashes of
    the draw, so a lost task gives the same reads again.
    """
    spark = isoforms.sparkSession
    drawn = draw(theta.select("isoform_id", "value"), draws(spark, n, seed)).select("draw", "isoform_id")
    placed = drawn.join(isoforms.select("isoform_id", "sequence"), "isoform_id")
    start = F.floor(uniform(seed + 1, F.col("draw")) * effective_length(F.col("sequence"), read_length))
    return placed.withColumn("start", start).select("draw", "isoform_id", "start", F.substr("sequence", (F.col("start") + 1).cast("int"), F.lit(read_length)).alias("read"))


def simulate(records: DataFrame, n: int, read_length: int, alpha: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Reads (header, sequence) and truth (isoform_id, length, psi, theta_true, theta_sampled).

    ``records``: isoform_id (0, 1, ...), header, sequence; those with PREDICTED in the header or shorter than a read go.
    The abundances are a vector on the driver.
    """
    import pandas as pd

    spark = records.sparkSession
    kept = keep_records(records, read_length).select("isoform_id", "header", "sequence", effective_length(F.col("sequence"), read_length).alias("length"))
    ids = kept.select("isoform_id", "length").orderBy("isoform_id").toPandas()
    psi = dirichlet(len(ids), alpha, seed)
    theta = psi * ids["length"].to_numpy(float)
    theta /= theta.sum()
    truth = spark.createDataFrame(pd.DataFrame({"isoform_id": ids["isoform_id"].to_numpy(), "length": ids["length"].to_numpy(), "psi": psi, "theta_true": theta}))
    reads = sampled_reads(kept, truth.select("isoform_id", F.col("theta_true").alias("value")), n, read_length, seed)
    counted = reads.groupBy("isoform_id").agg(F.count("*").alias("__n"))
    truth = truth.join(counted, "isoform_id", "left").withColumn("theta_sampled", F.coalesce(F.col("__n"), F.lit(0)) / float(n)).drop("__n")
    named = reads.join(kept.select("isoform_id", "header"), "isoform_id").select(F.concat(F.lit("sim-"), F.col("draw").cast("string"), F.lit("/"), F.col("header")).alias("header"), F.col("read").alias("sequence"))
    return named, truth


def every_kmer(spark, k: int) -> DataFrame:
    """One record whose sequence holds every k-mer once: header, sequence."""
    return spark.createDataFrame([(f"all-{k}-mers", de_bruijn(k))], "header string, sequence string")
