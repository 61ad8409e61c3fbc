"""Counts by minimisers against plain ones, and what they shuffle."""

import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.operators import counts, minimisers


def brute(reads, k):
    found = collections.Counter()
    for read in reads:
        for i in range(len(read or "") - k + 1):
            word = read[i : i + k]
            if set(word) <= set("ACGT"):
                found[int("".join(str("ACGT".index(c)) for c in word), 4)] += 1
    return dict(found)


def sample(seed, n=60, size=150):
    rng = random.Random(seed)
    genome = "".join(rng.choices("ACGT", k=2000))
    reads = [genome[a : a + size] for a in (rng.randrange(1850) for _ in range(n))]
    odd = ["A" * 700, "AC" * 200, "ACGTN" * 30, "N" * 40, "", None, "acgt" * 9, "ACG", "A" * 15, "ACGTACGTACGTACGN" + "T" * 31]
    return reads + odd


@pytest.mark.parametrize("k,m", [(15, 9), (31, 9), (5, 9), (1, 1), (31, 4)])
def test_against_plain_counts(spark, k, m):
    reads = sample(k)
    table = spark.createDataFrame([(r,) for r in reads], "sequence string")
    got = {r["kmer_id"]: r["y"] for r in minimisers.counts_by_minimiser(table, k, m).collect()}
    assert got == brute(reads, k) == {r["kmer_id"]: r["y"] for r in counts.kmer_counts(table, k).collect()}


def test_hot_minimisers_and_cut_reads(spark, monkeypatch):
    """Crowded minimisers are counted apart, and steps shorter than a read lose no window."""
    monkeypatch.setattr(minimisers, "LEAST_HOT", 20)
    monkeypatch.setattr(minimisers, "STEP", 97)
    reads = sample(3)
    table = spark.createDataFrame([(r,) for r in reads], "sequence string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert minimisers.hot_minimisers(minimisers.minimiser_runs(table, 15))
        assert {r["kmer_id"]: r["y"] for r in minimisers.counts_by_minimiser(table, 15).collect()} == brute(reads, 15)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize("least", [20, 10**6])
def test_partitions_grow_with_windows(spark, monkeypatch, least):
    """Partitions are as many as windows need, whatever the session's number, with and without crowded minimisers."""
    monkeypatch.setattr(minimisers, "LEAST_HOT", least)
    monkeypatch.setattr(minimisers, "TASK", 200)
    reads = sample(4) * 2
    table = spark.createDataFrame([(r,) for r in reads], "sequence string")
    want = brute(reads, 15)
    found = minimisers.counts_by_minimiser(table, 15)
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert found.rdd.getNumPartitions() >= sum(want.values()) // 200 and max(sizes) < len(want) / 4
    assert {r["kmer_id"]: r["y"] for r in found.collect()} == want and found.count() == len(want)


def test_empty(spark):
    assert minimisers.counts_by_minimiser(spark.createDataFrame([], "sequence string"), 15).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("ACGTN", max_size=400), st.integers(1, 31), st.integers(1, 12))
def test_runs_hold_all_windows(text, k, m):
    """The windows of the runs are the valid k-mers, and equal k-mers have one minimiser."""
    runs, code, n = minimisers.runs_of(text.encode(), k, min(m, k))
    found = collections.defaultdict(set)
    windows = [(run[i : i + k], c) for run, c, size in zip(runs, code.tolist(), n.tolist()) for i in range(size)]
    assert all(len(r) == size + k - 1 for r, size in zip(runs, n))
    for word, c in windows:
        found[word].add(c)
    want = [text[i : i + k].translate(str.maketrans("ACGT", "0123")) for i in range(len(text) - k + 1) if "N" not in text[i : i + k]]
    assert [w for w, _ in windows] == want and all(len(c) == 1 for c in found.values())


def shuffled(spark, action):
    """Bytes that an action shuffles, as the session's own store tells."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executorSummary("driver").totalShuffleWrite()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return store.executorSummary("driver").totalShuffleWrite() - before


@pytest.mark.parametrize("k,times", [(15, 2), (31, 3.5)])
def test_shuffle_falls(spark, k, times):
    """Reads of mostly distinct k-mers, as sequencing gives them: the shuffle of plain counts is several times as large."""
    rng = random.Random(k)
    table = spark.createDataFrame([("".join(rng.choices("ACGT", k=150)),) for _ in range(3000)], "sequence string").repartition(4).cache()
    table.count()
    plain = shuffled(spark, lambda: counts.kmer_counts(table, k).write.format("noop").mode("overwrite").save())
    found = minimisers.counts_by_minimiser(table, k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    own = shuffled(spark, lambda: found.write.format("noop").mode("overwrite").save())
    print(k, plain, own, plain / own)
    assert plain > times * own
