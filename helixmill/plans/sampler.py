"""Posterior means by a data-augmentation Gibbs sampler: theta has a Dirichlet prior, counts a multinomial law.

A step deals the count of each k-mer to its isoforms by a multinomial draw with their parts of X theta, and draws theta
from the Dirichlet law of the dealt counts. Draws come from generators keyed by (seed, chain, step, k-mer or isoform), so
that reruns and retried tasks agree. Chains run side by side as ``run``; means and variances accumulate in the table of
theta, and only the sums of each chain come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.plans.tables import Problems, given, scalars
from helixmill.session import Scratch, written


def generator(*key: int) -> np.random.Generator:
    """One for each key."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in key])))


def dealt(problems: Problems, theta: DataFrame, seed: int, step: int) -> DataFrame:
    """Counts of isoforms after each k-mer's count was dealt: run, isoform_id, n.

    Isoforms of a k-mer go one after another in order, each by a binomial draw of what is left, so that a k-mer of very
    many isoforms needs no more memory than others.
    """
    x = problems.entries.x
    weights = x.join(theta.select("run", "isoform_id", "value"), "isoform_id").select("run", "kmer_id", "isoform_id", (F.col("p") * F.col("value")).alias("w"))
    whole = weights.groupBy("run", "kmer_id").agg(F.sum("w").alias("whole")).join(problems.seen, ["run", "kmer_id"])
    rows = weights.join(whole, ["run", "kmer_id"]).repartition("run", "kmer_id").sortWithinPartitions("run", "kmer_id", "isoform_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rng, rest, weight = None, None, 0, 0.0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("run", "kmer_id", "w", "whole", "y")]
            out = np.zeros(batch.num_rows, np.int64)
            for i, (chain, kmer, w, whole, y) in enumerate(zip(*columns, strict=True)):
                if (chain, kmer) != now:
                    now, rng, rest, weight = (chain, kmer), generator(seed, chain, step, kmer), round(y), whole
                if rest and w > 0:
                    # The last one gets what is left, up to the rounding of sums.
                    out[i] = rest if w >= weight * (1 - 1e-12) else rng.binomial(rest, min(1.0, w / weight))
                    rest -= out[i]
                    weight -= w
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("isoform_id"), pa.array(out)], ["run", "isoform_id", "n"])

    counted = rows.select("run", "kmer_id", "isoform_id", "w", "whole", "y").mapInArrow(run, "run bigint, isoform_id bigint, n bigint")
    return counted.groupBy("run", "isoform_id").agg(F.sum("n").alias("n"))


def gammas(counts: DataFrame, alpha: float, seed: int, step: int) -> DataFrame:
    """Adds a draw from the gamma law of shape ``alpha`` + n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [generator(seed, -1 - chain, step, isoform).standard_gamma(alpha + n) for chain, isoform, n in zip(*(batch.column(c).to_pylist() for c in ("run", "isoform_id", "n")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.float64())], [*batch.schema.names, "drawn"])

    return counts.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in counts.dtypes) + ", drawn double")


def posterior(x: DataFrame, y: DataFrame, isoforms: DataFrame, alpha: float = 1.0, chains: int = 4, draws: int = 100, warmup: int = 50, seed: int = 0) -> DataFrame:
    """isoform_id, mean and variance of theta over ``chains`` times ``draws`` draws, after ``warmup`` of each chain.

    ``y``: kmer_id, y. ``alpha``: the Dirichlet prior's.
    """
    scratch = Scratch(x.sparkSession)
    each = y.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chains - 1).cast("bigint"))).alias("run"), "kmer_id", "y")
    problems = Problems(x, each, isoforms, scratch)
    state = scratch.write(problems.uniform().withColumn("sum", F.lit(0.0)).withColumn("square", F.lit(0.0)))
    for step in range(warmup + draws):
        n = dealt(problems, state, seed, step)
        counts = state.select("run", "isoform_id", "sum", "square").join(n, ["run", "isoform_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
        drawn = scratch.write(gammas(counts, alpha, seed, step))
        theta = given(drawn, whole={r: v["g"] for r, v in scalars(drawn, g=F.sum("drawn")).items()}).withColumn("value", F.col("drawn") / F.col("whole"))
        kept = F.lit(1.0 if step >= warmup else 0.0)
        new = scratch.write(theta.select("run", "isoform_id", "value", (F.col("sum") + kept * F.col("value")).alias("sum"), (F.col("square") + kept * F.col("value") * F.col("value")).alias("square")))
        scratch.drop(state, drawn)
        state = new
    total = float(chains * draws)
    out = state.groupBy("isoform_id").agg((F.sum("sum") / total).alias("mean"), F.sum("square").alias("square"))
    out = written(out.select("isoform_id", "mean", F.greatest((F.col("square") - total * F.col("mean") * F.col("mean")) / max(total - 1, 1.0), F.lit(0.0)).alias("variance")))
    scratch.drop()
    return out
