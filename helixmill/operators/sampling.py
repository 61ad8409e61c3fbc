"""Categorical sampling by inverse distribution function, and counts of what was drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.bases import uniform
from helixmill.operators.linalg import over_all, share
from helixmill.operators.order import running
from helixmill.session import written

#: Cells of the unit interval at least; there are about as many as categories, so that the range join is an equi-join
#: on cells that each hold few categories.
CELLS = 1024


def cumulative(p: DataFrame, order: str = "isoform_id", value: str = "value") -> DataFrame:
    """Adds low and high, the interval of each category; the last one ends at 1 or above."""
    summed = running(p, [order], value, "low").withColumn("low", F.col("low").cast("double"))
    high = F.col("low") + F.col(value)
    return summed.withColumn("high", F.when(F.col(order) == over_all(p, F.max(order)), F.greatest(high, F.lit(1.0))).otherwise(high))


def draw(p: DataFrame, draws: DataFrame, u: str = "u", order: str = "isoform_id") -> DataFrame:
    """Joins each draw to the category whose interval holds ``u``: a range join by cells of the unit interval.

    ``p`` is written first, as its ranges, their sums and its last category are read from it.
    """
    p = written(p)
    cells = max(CELLS, 1 << p.count().bit_length())
    ranges = cumulative(p, order).where("high > low")
    first, last = F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells).cast("bigint"))
    spread = ranges.withColumn("__cell", F.explode(F.sequence(first, last)))
    keyed = draws.withColumn("__cell", F.floor(F.col(u) * cells))
    return keyed.join(spread, "__cell").where((F.col(u) >= F.col("low")) & (F.col(u) < F.col("high"))).drop("__cell")


def draws(spark, n: int, seed: int) -> DataFrame:
    """``n`` draws: draw, u."""
    return spark.range(n).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u"))


def bincount(drawn: DataFrame, categories: DataFrame, key: str = "isoform_id") -> DataFrame:
    """Draws of each category, 0 where none: key, n, share of all draws."""
    counted = drawn.groupBy(key).agg(F.count("*").alias("n"))
    filled = categories.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return filled.withColumn("share", share(filled, F.col("n")))
