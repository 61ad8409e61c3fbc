import gzip

import pytest

from helixmill.operators import counts
from helixmill.sources import files
from helixmill.sources.store import ModelSettings, Problem, Store, config_hash, write_csv

ONE = "\n>ABC hello\nACGT\n\n>DEF goodbye\nAACGT\n"
FOUR = ">ABC1 one\nAAACAGATCACCCGCT\n>ABC2 two\nTGAGCGGGTTATCTGTT\n>ABC3 three\nAACCGGTTAAACCCGGG\n"
FOLDED = ">ABC1 one\nAAACAGATCACCCGCT\n\n>ABC2 two  \nTGA\nGCGGGTT\n ATCT \nGTT\n>ABC3 three\nAACCGGTTAA\nACCCGGG\n"


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def records(df):
    return [(r["header"], r["sequence"]) for r in df.orderBy("file", "block").collect()]


def test_fasta_records(spark, tmp_path):
    got = records(files.read_fasta(spark, put(tmp_path, "one.fsa", ONE)))
    assert got == [("ABC hello", "ACGT"), ("DEF goodbye", "AACGT")]


def test_fasta_line_folding_and_multiple_files(spark, tmp_path):
    four, folded = put(tmp_path, "four.fsa", FOUR), put(tmp_path, "folded.fsa", FOLDED)
    assert records(files.read_fasta(spark, four)) == records(files.read_fasta(spark, folded))
    assert len(records(files.read_fasta(spark, [four, folded]))) == 6


def test_fasta_without_records(spark, tmp_path):
    assert records(files.read_fasta(spark, put(tmp_path, "none.fsa", ""))) == []
    assert records(files.read_fasta(spark, put(tmp_path, "text.fsa", "no record\nhere\n"))) == []
    with pytest.raises(Exception):
        files.read_fasta(spark, str(tmp_path / "missing.fsa")).count()


def test_fasta_native_takes_first_line_as_header(spark, tmp_path):
    got = records(files.read_fasta_native(spark, put(tmp_path, "n.fsa", "first\nAC  \nGT\n>second\nTT\n")))
    assert got == [("first", "ACGT"), (">second", "TT")]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a 1", "ACGT" * 40), ("b 2", "A" * 50), ("c", "T" * 51)], "header string, sequence string")
    files.write_fasta(df, str(tmp_path / "out"), width=50)
    assert sorted(records(files.read_fasta(spark, str(tmp_path / "out")))) == sorted((r[0], r[1]) for r in df.collect())
    files.write_fasta_by(df.withColumnRenamed("header", "id").selectExpr("id", "id AS header", "sequence"), str(tmp_path / "by"), "id")
    assert files.read_fasta(spark, str(tmp_path / "by" / "*")).count() == 3


def test_fastq_gz(spark, tmp_path):
    path = tmp_path / "r.fastq.gz"
    with gzip.open(path, "wt") as f:
        f.write("@r1\nAAC\n+\nIII\n@r2\nACG\n+\nIII\n")
    got = files.read_fastq(spark, str(path))
    assert [(r["header"], r["sequence"]) for r in got.orderBy("seq_idx").collect()] == [("r1", "AAC"), ("r2", "ACG")]
    per_read = {r["kmer_id"]: r["y"] for r in counts.kmer_counts(got, 2).collect()}
    assert per_read == {0: 1, 1: 2, 6: 1}
    spanning = {r["kmer_id"]: r["y"] for r in counts.spanning_counts(got, 2).collect()}
    assert spanning == {0: 1, 1: 2, 4: 1, 6: 1}


def test_fastq_damaged(spark, tmp_path):
    with pytest.raises(Exception, match="incomplete FASTQ"):
        files.read_fastq(spark, put(tmp_path, "bad.fastq", "@r1\nAAC\n+\n")).collect()


def test_quant_and_lists(spark, tmp_path):
    assert files.read_quant(spark, put(tmp_path, "q.sf", "Name\tLength\tNumReads\nA\t10\t3\n")).first()["NumReads"] == "3"
    got = files.read_list(spark, put(tmp_path, "duds.txt", "A.fa\nB.fa \nC\n\n"))
    assert sorted(r["id"] for r in got.collect()) == ["A", "B", "C"]


def test_store(spark, tmp_path):
    store, problem = Store(spark, str(tmp_path)), Problem("x.fsa", K=3)
    built = []

    def build():
        built.append(1)
        return spark.range(5).withColumnRenamed("id", "kmer_id")

    for _ in range(2):
        assert store.cached(build, "y", problem, ModelSettings(), cluster="kmer_id").count() == 5
    assert len(built) == 1
    store.cached(build, "y", problem, ModelSettings(), force_repeat=True)
    assert len(built) == 2
    assert config_hash({"a": 1, "b": {"c": 2}}) == config_hash({"b": {"c": 2}, "a": 1}) != config_hash({"a": 2})
    write_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id"]
    assert "K3" in store.title(problem, ModelSettings())


def test_fasta_is_read_in_splits_without_a_shuffle(spark, tmp_path):
    """Records that fall across many small splits, in several files; the first lines differ."""
    want = []
    for f in range(3):
        rows = [(f"f{f} record {i} >inside", "ACGT" * (1 + (i * 7 + f) % 40)) for i in range(200)]
        lead = ("", "\n\n", "no record\n")[f]
        put(tmp_path, f"part{f}.fsa", lead + "".join(f">{h}\n{s[:30]}\n{s[30:]}\n" for h, s in rows))
        want += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        df = files.read_fasta(spark, str(tmp_path / "*.fsa"))
        assert df.rdd.getNumPartitions() > 40
        got = df.orderBy("file", "block").collect()
        assert [(r["header"], r["sequence"]) for r in got] == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
        native = [(r["header"], r["sequence"]) for r in files.read_fasta_native(spark, str(tmp_path / "part0.fsa")).orderBy("block").collect()]
        assert native == [(">" + h, s) for h, s in want[:200]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_folders_have_a_partition_for_each_file(spark, tmp_path):
    for name, n in (("a.fastq", 3), ("b.fastq.gz", 5000), ("_hidden", 1)):
        text = "".join(f"@{name} {i}\n{'ACGT' * (1 + i % 3)}\n+\nIIII\n" for i in range(n))
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    df = files.read_fastq(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2 and df.count() == 5003
    last = df.where("file LIKE '%b.fastq.gz' AND seq_idx = 4999").first()
    assert (last["header"], last["sequence"]) == ("b.fastq.gz 4999", "ACGT" * 2)
    assert files.read_fastq(spark, [str(tmp_path / "a.fastq"), f"file://{tmp_path}/b.fastq.gz"]).count() == 5003
    with pytest.raises(Exception, match="missing"):
        files.read_fastq(spark, str(tmp_path / "missing.fastq")).count()


@pytest.mark.parametrize("split", [1, 7, 50, 333])
def test_fastq_in_ranges(spark, tmp_path, split):
    """Quality lines that look like headers, CRLF, and ranges down to a byte: the rows and numbers of the file as a whole."""
    rows = [(f"r{i} @x", "ACGTN"[: i % 6] * (i % 4), "@+I@"[i % 4] * len("ACGTN"[: i % 6] * (i % 4))) for i in (range(5, 6) if split == 1 else range(60))]
    text = "".join(f"@{h}\n{s}\n+{h if i % 3 else ''}\n{q}\n" for i, (h, s, q) in enumerate(rows))
    for name, body in (("a.fastq", text), ("b.fastq", text.replace("\n", "\r\n").removesuffix("\r\n"))):
        path = put(tmp_path, name, "") and tmp_path / name
        path.write_bytes(body.encode())
        got = [tuple(r) for r in files.read_fastq(spark, str(path), split).select("seq_idx", "header", "sequence").orderBy("seq_idx").collect()]
        assert got == [(i, h, s) for i, (h, s, _) in enumerate(rows)]
        assert got == [tuple(r) for r in files.read_fastq(spark, str(path)).select("seq_idx", "header", "sequence").orderBy("seq_idx").collect()]


def test_fastq_range_of_a_broken_file(spark, tmp_path):
    path = put(tmp_path, "broken.fastq", "@a\nACGT\n+\nIIII\n@b\nAC\n")
    for split in (5, 1000):
        with pytest.raises(Exception, match="incomplete"):
            files.read_fastq(spark, path, split).count()
