"""Errors by the bootstrap and choice of a prior by cross-validation: refits of many thetas over one X, one job a step."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.bases import uniform
from helixmill.operators.counts import bootstrap_counts
from helixmill.operators.shred import code_of, shred, spread
from helixmill.plans.tables import Problems, SimplexProblems, exponentiated, multiplicative, scalars
from helixmill.session import Scratch, written


def bootstrap_errors(x: DataFrame, reads: DataFrame, isoforms: DataFrame, k: int, replicates: int, seed: int, key: tuple[str, ...], iterations: int = 100) -> DataFrame:
    """isoform_id, mean and error (standard deviation) of theta, fitted anew to the counts of resampled reads.

    ``isoforms``: isoform_id, length. A replicate is a run, so a step of all replicates is one job.
    """
    scratch = Scratch(x.sparkSession)
    y = bootstrap_counts(reads, k, replicates, seed, key).select(F.col("replicate").alias("run"), "kmer_id", "y")
    problems = SimplexProblems(x, scratch.write(y), isoforms, scratch)
    state = multiplicative(problems, problems.uniform(), iterations).state
    out = written(state.groupBy("isoform_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("error")))
    scratch.drop()
    return out


def fold_counts(reads: DataFrame, k: int, folds: int, seed: int, key: tuple[str, ...], sequence: str = "sequence") -> DataFrame:
    """Counts of each fold's reads: fold, kmer_id, y. A read's fold is drawn from a hash of its key."""
    drawn = reads.select(sequence, F.floor(uniform(seed, *map(F.col, key)) * folds).alias("fold"))
    counted = shred(spread(drawn), k, sequence, ("fold",)).groupBy("fold", "kmer").agg(F.count("*").alias("y"))
    return counted.select("fold", code_of(F.col("kmer")).alias("kmer_id"), "y")


def held_out(problems: Problems, theta: DataFrame, tests: DataFrame) -> dict[int, float]:
    """Mean log of X theta over counts that were held out (run, kmer_id, y), those of k-mers that X has; -inf at 0."""
    at = problems.entries.forward(theta).join(tests.select("run", "kmer_id", F.col("y").alias("held")), ["run", "kmer_id"])
    part = F.when(F.col("value") > 0, F.col("held") * F.log("value")).otherwise(F.lit(-math.inf))
    return {r: v["f"] / float(v["n"]) for r, v in scalars(at, f=F.sum(part), n=F.sum("held")).items()}


def cross_validation(x: DataFrame, reads: DataFrame, isoforms: DataFrame, k: int, betas: list[float], folds: int, seed: int, key: tuple[str, ...], iterations: int = 100) -> DataFrame:
    """beta, fold, loglik (of the fold's reads by theta fitted to the others): a run for each fold and beta."""
    scratch = Scratch(x.sparkSession)
    own = scratch.write(fold_counts(reads, k, folds, seed, key))
    runs = F.explode(F.array(*(F.struct(F.lit(f).alias("test"), F.lit(b).alias("b")) for f in range(folds) for b in range(len(betas)))))
    rows = own.withColumn("r", runs).withColumn("run", (F.col("r.test") * len(betas) + F.col("r.b")).cast("bigint"))
    trained = rows.where("fold <> r.test").groupBy("run", "kmer_id").agg(F.sum("y").alias("y"))
    tests = scratch.write(rows.where("fold = r.test").select("run", "kmer_id", "y"))
    problems = SimplexProblems(x, scratch.write(trained), isoforms, scratch, {f * len(betas) + b: beta for f in range(folds) for b, beta in enumerate(betas)})
    fit = exponentiated(problems, problems.uniform(), iterations)
    found = held_out(problems, fit.state, tests)
    scratch.drop()
    return x.sparkSession.createDataFrame([(float(betas[r % len(betas)]), r // len(betas), f) for r, f in sorted(found.items())], "beta double, fold bigint, loglik double")
