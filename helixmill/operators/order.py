"""Numbering and running sums in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import written


def running(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over the rows that come earlier in the order, 0 for the first.

    Rows are dealt into ranges of the order and written, so that both passes see the same ranges. Each range sums its own
    rows and is moved by the totals of the ranges before it, a table with a row for each range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__p").agg(F.sum(value).alias("__t")).select("__p", F.coalesce(F.sum("__t").over(ranges), F.lit(0)).alias("__b"))
    summed = ranged.withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(totals), "__p").withColumn(out, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")
