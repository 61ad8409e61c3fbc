"""Errors of estimates and reductions of curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.linalg import over_all


def l1_errors(snapshots: DataFrame, truth: DataFrame) -> DataFrame:
    """iteration, l1: distance of each snapshot (iteration, isoform_id, value) to the truth (isoform_id, value)."""
    joined = snapshots.join(truth.select("isoform_id", F.col("value").alias("__t")), "isoform_id")
    return joined.groupBy("iteration").agg(F.sum(F.abs(F.col("value") - F.col("__t"))).alias("l1"))


def errors(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: l1, rmse, and root_norm_by_size, the root of (2-norm / size)."""
    d = F.col("value") - F.col("__t")
    joined = estimate.join(truth.select("isoform_id", F.col("value").alias("__t")), "isoform_id")
    return joined.agg(F.sum(F.abs(d)).alias("l1"), F.sqrt(F.sum(d * d) / F.count("*")).alias("rmse"), F.sqrt(F.sqrt(F.sum(d * d)) / F.count("*")).alias("root_norm_by_size"))


def residuals(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """isoform_id, estimate, residual (estimate - truth)."""
    joined = estimate.join(truth.select("isoform_id", F.col("value").alias("__t")), "isoform_id")
    return joined.select("isoform_id", F.col("value").alias("estimate"), (F.col("value") - F.col("__t")).alias("residual"))


def curves(runs: DataFrame, threshold: float | None = None) -> DataFrame:
    """mean, least and most over runs at each iteration that all runs reach; cut after the first mean <= threshold.

    ``runs``: run, iteration, value.
    """
    end = over_all(runs.groupBy("run").agg(F.max("iteration").alias("end")), F.min("end"))
    reduced = runs.groupBy("iteration").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    reduced = reduced.where(F.col("iteration") <= end)
    if threshold is None:
        return reduced
    first = over_all(reduced, F.min(F.when(F.col("mean") <= threshold, F.col("iteration"))))
    return reduced.where(F.col("iteration") <= F.coalesce(first, F.col("iteration")))
