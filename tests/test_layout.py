"""Stored layouts and logs of counts: exchanges, reruns, compaction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.plans.model import Evaluator
from helixmill.sources.store import ModelSettings, Problem, Store
from helixmill.streaming.counts import CountLog, counts_available_now

X = [(i % 40, j, 0.1 + (i + j) % 3) for i in range(40) for j in range(5) if (i + j) % 2]
Y = [(i, i + 1) for i in range(0, 60, 2)]


def exchanges(table):
    """Exchanges of a plan, without sides that are broadcast."""
    return table._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


@pytest.fixture
def shuffled_joins(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_buckets_join_and_aggregate_without_an_exchange(shuffled_joins, tmp_path):
    spark, problem = shuffled_joins, Problem("a.fa", K=3)
    store = Store(spark, f"file://{tmp_path}/store")
    x = spark.createDataFrame(X, "kmer_id bigint, isoform_id bigint, p double")
    y = spark.createDataFrame(Y, "kmer_id bigint, y bigint")
    for table, kind in ((x, "x"), (y, "y")):
        store.save_bucketed(table, kind, problem, by="kmer_id", buckets=4)
    plain = x.join(y, "kmer_id").groupBy("kmer_id").agg(F.sum("p").alias("s"), F.first("y").alias("y"))
    for again in (False, True):
        if again:  # a session that doesn't know the tables yet
            for kind in ("x", "y"):
                spark.sql(f"DROP TABLE {store._table(store.path(kind, problem))}")
        held = Store(spark, f"file://{tmp_path}/store")
        own_x, own_y = held.load("x", problem), held.load("y", problem)
        joined = own_x.join(own_y, "kmer_id")
        summed = joined.groupBy("kmer_id").agg(F.sum("p").alias("s"), F.first("y").alias("y"))
        assert exchanges(joined) == exchanges(summed) == 0 < exchanges(plain)
        assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(own_x.dtypes) == sorted(x.dtypes)
    one, other = Evaluator(own_x, own_y, 5, placed=True), Evaluator(x, y, 5)
    assert exchanges(one.entries) == 0
    theta = np.arange(1, 6) / 15
    assert abs(one.likelihood(theta) - other.likelihood(theta)) < 1e-12
    np.testing.assert_allclose(one.likelihood_and_pull(theta)[1], other.likelihood_and_pull(theta)[1], rtol=1e-12)
    one.close()
    other.close()
    store.save_bucketed(y, "x", problem, by="kmer_id", buckets=2)  # another layout in its place
    assert sorted(map(tuple, store.load("x", problem).collect())) == sorted(Y)
    store.save(y, "y", ModelSettings())
    assert store.load("y", ModelSettings()).count() == len(Y)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """All rows of one value, and still no task that sorts them all."""
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store, problem = Store(spark, f"file://{tmp_path}/store"), Problem("b.fa", K=3)
        x = spark.range(0, 200_000, 1, 8).select(F.lit(5).cast("bigint").alias("kmer_id"), F.col("id").alias("isoform_id"), F.rand(1).alias("p"))
        store.save_bucketed(x, "x", problem, by="kmer_id", buckets=2)
        back = store.load("x", problem)
        sizes = [r["n"] for r in back.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 200_000 and max(sizes) < 100_000
        assert back.agg(F.countDistinct("isoform_id")).first()[0] == 200_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)


def total(log):
    return {r["kmer_id"]: r["y"] for r in log.counts().collect()}


def test_log_of_counts(spark, tmp_path):
    """Deltas of batches in any order, repeated ones, and compaction by tiers that may be cut off."""
    log = CountLog(spark, f"file://{tmp_path}/log")
    batch = lambda *reads: spark.createDataFrame([(r,) for r in reads], "sequence string")
    assert total(log) == {} and log.deltas() == []
    for i in range(9):
        log.add(batch("ACG", "AC" * (i + 1)), i, 2)
    want = total(log)
    assert want[1] == sum(1 + (i + 1) for i in range(9)) and want[6] == 9
    log.add(batch("ACG", "AC" * 4), 3, 2)  # batch 3 again
    assert total(log) == want and len(log.cover()) == 9
    log.compact(2)
    assert log.cover() == [(0, 7), (8, 8)] == log.deltas() and total(log) == want
    log.add(batch("ACG", "AC" * 4), 3, 2)  # and after it was summed
    assert total(log) == want and log.cover() == [(0, 7), (8, 8)]
    log._sum([(8, 8)]).write.parquet(f"file://{tmp_path}/log/deltas/0-15")
    path, store = log._path(f"file://{tmp_path}/log/deltas/0-15/_SUCCESS")
    store.delete(path, False)  # a compaction that was cut off
    assert total(log) == want


def test_stream_goes_on(spark, tmp_path):
    """New files are new batches of a later call; each batch writes its own counts alone."""
    arrived, folder = f"{tmp_path}/arrived", f"{tmp_path}/out"
    spark.createDataFrame([("ACGT",), ("ACGA",), ("TTTT",), (None,)], "sequence string").repartition(3).write.parquet(arrived)
    stream = lambda: spark.readStream.schema("sequence string").option("maxFilesPerTrigger", 1).parquet(arrived)
    got = {r["kmer_id"]: r["y"] for r in counts_available_now(spark, stream(), 3, folder).collect()}
    assert got == {6: 2, 27: 1, 24: 1, 63: 2}
    spark.createDataFrame([("TTT",)], "sequence string").coalesce(1).write.mode("append").parquet(arrived)
    got = {r["kmer_id"]: r["y"] for r in counts_available_now(spark, stream(), 3, folder).collect()}
    assert got == {6: 2, 27: 1, 24: 1, 63: 3}
    log = CountLog(spark, f"{folder}/counts")
    assert len(log.cover()) >= 3
    last = spark.read.parquet(f"{folder}/counts/deltas/{log.cover()[-1][0]}-{log.cover()[-1][1]}")
    assert [tuple(r) for r in last.collect()] == [(63, 1)]
