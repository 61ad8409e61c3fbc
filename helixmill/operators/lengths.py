"""Between transcript-level (psi) and read-level (theta) abundance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.linalg import share


def adjust(psi: DataFrame, lengths: DataFrame) -> DataFrame:
    """theta = psi * length, normalised: isoform_id, value. ``lengths``: isoform_id, length."""
    both = psi.join(lengths, "isoform_id")
    return both.select("isoform_id", share(both, F.col("value") * F.col("length")).alias("value"))


def adjust_inverse(theta: DataFrame, lengths: DataFrame) -> DataFrame:
    """psi = theta / length, normalised."""
    both = theta.join(lengths, "isoform_id")
    return both.select("isoform_id", share(both, F.col("value") / F.col("length")).alias("value"))
