"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """node and component (the least node that it reaches) for each node of ``edges`` (u, v: bigint).

    Each round is written to the shared folder, so lineage stays short and lost executors cost one round at most; the
    tables of a round go with it, and the last one when ``scratch`` is dropped. Minima are written before they are
    joined, so that the join is of two plain shuffles and Spark can split a node with very many edges. Stops when a
    round changes nothing; raises if that needs more than ``rounds``.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))))
    last = tuple(now.agg(mark.alias("m")).first()["m"])
    for _ in range(rounds):
        if not last[0]:
            break
        own = Scratch(edges.sparkSession)
        after = scratch.write(_small_star(_large_star(now, own), own))
        own.drop()
        scratch.drop(now)
        now = after
        found = tuple(now.agg(mark.alias("m")).first()["m"])
        if found == last:
            break
        last = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # All edges now lead from a node to its least one.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
