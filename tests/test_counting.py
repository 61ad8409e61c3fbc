import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.functions.bases import decode, encode
from helixmill.operators import counts, matrix
from helixmill.operators import shred as shred_module
from helixmill.operators.shred import CHUNK, shred, shred_pairs, shred_positions, spanning_blocks
from helixmill.plans.simulate import de_bruijn


def frame(spark, *sequences):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "isoform_id bigint, sequence string")


def brute(sequences, k):
    out = Counter()
    for s in sequences:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                out[sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(w))] += 1
    return out


def test_codes(spark):
    df = spark.createDataFrame([("AA",), ("AC",), ("CA",), ("TT",), ("aC",), ("AN",), ("",), (None,)], "kmer string")
    assert [r[0] for r in df.select(encode(F.col("kmer"))).collect()] == [0, 1, 4, 15, None, None, None, None]
    long = spark.createDataFrame([("T" * 31,)], "kmer string").select(encode(F.col("kmer")).alias("c"))
    assert long.first()[0] == 4**31 - 1
    assert long.select(decode(F.col("c"), 31)).first()[0] == "T" * 31


def test_counting_example(spark):
    assert {r["kmer_id"]: r["y"] for r in counts.kmer_counts(frame(spark, "AACAC"), 2).collect()} == {0: 1, 1: 2, 4: 1}


def test_pairs_example(spark):
    df = spark.createDataFrame([("ATCAG", "CGCGC")], "a string, b string")
    got = Counter(r["kmer"].translate(str.maketrans("0123", "ACGT")) for r in shred_pairs(df, 3, "a", "b").collect())
    assert got == Counter(["ATC", "TCA", "CAG", "CGC", "GCG", "CGC"])


@pytest.mark.parametrize("k", [1, 3, 15, 31])
def test_counts_against_brute_force(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTNacgt") if rng.random() < 0.02 else rng.choice("ACGT") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, CHUNK, CHUNK + k, 3 * CHUNK + 7)] + [None]
    got = {r["kmer_id"]: r["y"] for r in counts.kmer_counts(frame(spark, *texts), k).collect()}
    assert got == dict(brute(texts, k))
    positions = shred_positions(frame(spark, *texts), k, "sequence", ("isoform_id",)).collect()
    assert Counter(r["kmer_id"] for r in positions) == brute(texts, k)
    assert all(brute([texts[r["isoform_id"]][r["position"] : r["position"] + k]], k) == {r["kmer_id"]: 1} for r in positions)


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text("ACGTN-é", max_size=40), max_size=5), k=st.integers(1, 5))
def test_counts_property(spark, texts, k):
    got = {r["kmer_id"]: r["y"] for r in counts.kmer_counts(frame(spark, "", *texts), k).collect()}
    assert got == dict(brute(texts, k))


def test_counts_add_up(spark):
    a, b = frame(spark, "ACGTACG"), frame(spark, "GGGTAC")
    both = {r["kmer_id"]: r["y"] for r in counts.kmer_counts(a.unionByName(b), 2).collect()}
    parts = Counter()
    for x in (a, b):
        parts.update({r["kmer_id"]: r["y"] for r in counts.kmer_counts(x, 2).collect()})
    assert both == dict(parts)


def test_de_bruijn(spark):
    for k in (1, 2, 5):
        assert len(de_bruijn(k)) == 4**k + k - 1
        got = counts.zero_filled(counts.kmer_counts(frame(spark, de_bruijn(k)), k), k)
        assert [r["y"] for r in got.collect()] == [1] * 4**k


def test_matrix_k1(spark):
    x = {(r["kmer_id"], r["isoform_id"]): r["p"] for r in matrix.build_matrix(frame(spark, "ACGT", "AACGT"), 1).collect()}
    assert x == {(i, 0): 0.25 for i in range(4)} | {(0, 1): 0.4, (1, 1): 0.2, (2, 1): 0.2, (3, 1): 0.2}


def test_matrix_k2(spark):
    x = {(r["kmer_id"], r["isoform_id"]): r["p"] for r in matrix.build_matrix(frame(spark, "AACC", "CCGG", "TTTT", "NNNN"), 2).collect()}
    third = pytest.approx(1 / 3)
    assert x == {(0, 0): third, (1, 0): third, (5, 0): third, (5, 1): third, (6, 1): third, (10, 1): third, (15, 2): 1.0}


@pytest.mark.parametrize("k,step", [(1, 7), (3, 50), (3, 1 << 20), (8, 64), (31, 90)])
def test_matrix_against_brute_force(spark, monkeypatch, k, step):
    """Rows longer than a step, rows that share an id, characters of several bytes, empty and null rows."""
    monkeypatch.setattr(shred_module, "STEP", step)
    rng = random.Random(k)
    rows = [(i % 20, "".join(rng.choice("ACGTNé\U0001f600\n") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(rng.choice([0, 1, k, 60, 300])))) for i in range(30)] + [(50, None), (51, "NN"), (None, "ACGT" * 20)]
    x = matrix.build_matrix(spark.createDataFrame(rows, "isoform_id bigint, sequence string"), k)
    assert x.rdd.getNumPartitions() >= matrix.PARTS
    got = {(r["isoform_id"], r["kmer_id"]): (r["cnt"], r["p"]) for r in x.collect()}
    assert x.count() == len(got)
    want = {i: brute([s or "" for j, s in rows if j == i], k) for i in {i for i, _ in rows}}
    assert got == {(i, m): (n, n / sum(own.values())) for i, own in want.items() for m, n in own.items()}


def test_matrix_columns_sum_to_one_and_spmv(spark):
    from helixmill.operators import linalg

    x = matrix.build_matrix(frame(spark, "AAACAGATCACCCGCT", "TGAGCGGGTTATCTGTT", "AACCGGTTAAACCCGGG"), 2)
    assert x.count() == 31
    theta = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "isoform_id bigint, value double")
    assert linalg.spmv(x, theta).agg(F.sum("value")).first()[0] == pytest.approx(1)


def test_files_in_order_and_short_ones_empty(spark):
    df = spark.createDataFrame([("f", 1, "ACG"), ("f", 0, "TT"), ("g", 0, "A")], "file string, n bigint, sequence string")
    got = {r["kmer_id"]: r["p"] for r in matrix.file_matrix(df, 3, "file", "n", 3).where("isoform_id = 'f'").collect()}
    assert got == {i: 1 / 3 for i in brute(["TTACG"], 3)} and matrix.file_matrix(df, 3, "file", "n", 3).where("isoform_id = 'g'").isEmpty()
    assert [r["file"] for r in matrix.short_files(df, "file", 3).collect()] == ["g"]


def test_read_aware_example(spark):
    got = {r["kmer_id"]: r["p"] for r in matrix.read_aware_matrix(frame(spark, "ATGGCAATG"), 4, 6).collect()}
    words = {"ATGG": 1, "TGGC": 2, "GGCA": 3, "GCAA": 3, "CAAT": 2, "AATG": 1}
    assert got == {next(iter(brute([w], 4))): pytest.approx(n / 12) for w, n in words.items()}


def test_dense_ids_and_filters(spark):
    df = spark.createDataFrame([(i, f"h{i}" + " PREDICTED" * (i % 3 == 0), "A" * i) for i in range(40)], "n bigint, header string, sequence string").repartition(5)
    kept = matrix.keep_records(df, 10)
    got = sorted((r["n"], r["isoform_id"]) for r in matrix.dense_ids(kept, "n").collect())
    assert got == [(n, i) for i, n in enumerate(n for n in range(10, 40) if n % 3)]
    assert shred(df.where("n < 0"), 2).count() == 0


@pytest.mark.parametrize("k,block", [(1, 7), (4, 5), (5, 64), (12, 3)])
def test_spanning_blocks_against_joined_reads(spark, k, block):
    rng = random.Random(k * 100 + block)
    reads = [(f, i, "".join(rng.choice("ACGTN") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2, 3, 40])))) for f in "abc" for i in range(30)] + [("d", 0, None), ("d", 1, "AC")]
    df = spark.createDataFrame(reads, "file string, seq_idx int, sequence string")
    joined = ["".join(s or "" for f, _, s in reads if f == g) for g in "abcd"]
    got = {r["kmer_id"]: r["y"] for r in counts.kmer_counts(spanning_blocks(df, k, "file", "seq_idx", block=block), k).collect()}
    assert got == brute(joined, k)
    x = {(r["isoform_id"], r["kmer_id"]): (r["cnt"], r["p"]) for r in matrix.file_matrix(df, k, "file", "seq_idx", 3).collect()}
    for name, text in zip("abcd", joined):
        own = brute([text], k) if len(text) >= 3 else {}
        assert {m: c for (f, m), (c, _) in x.items() if f == name} == own
        assert not own or abs(sum(p for (f, _), (_, p) in x.items() if f == name) - 1) < 1e-9
    assert [r["file"] for r in matrix.short_files(df, "file", 3).collect()] == ["d"]


@pytest.mark.parametrize("k,length", [(3, 6), (4, 4), (2, 150)])
def test_read_aware_weights_against_reads(spark, k, length):
    rng = random.Random(length)
    isoforms = ["".join(rng.choice("ACGTN" if i % 2 else "ACGT") for _ in range(n)) for i, n in enumerate((3, 5, 6, 7, 40, 300, 149, 150))]
    got = {(r["isoform_id"], r["kmer_id"]): r["weight"] for r in matrix.read_aware_matrix(frame(spark, *isoforms), k, length).collect()}
    want = {(i, m): n for i, s in enumerate(isoforms) for m, n in brute([s[j : j + length] for j in range(len(s) - length + 1)], k).items()}
    assert got == want


def test_long_runs_are_cut_in_one_pass(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(3_000_000))
    begun = time.monotonic()
    assert sum(r["y"] for r in counts.kmer_counts(frame(spark, text), 4).collect()) == len(text) - 3
    assert time.monotonic() - begun < 60


def test_shapes(spark):
    x = matrix.build_matrix(frame(spark, "ACGT", "AACC"), 2)
    y = counts.kmer_counts(frame(spark, "ACGTT"), 2)
    lengths = spark.createDataFrame([(0, 3), (1, 3)], "isoform_id bigint, length bigint")
    matrix.check_shapes(x, y, lengths, 2)
    for parts in ((x, y, lengths.where("isoform_id = 0")), (x, y.selectExpr("kmer_id + 20 AS kmer_id", "y"), lengths)):
        with pytest.raises(ValueError):
            matrix.check_shapes(*parts, 2)
