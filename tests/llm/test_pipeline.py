"""Each stage against a plain version of what it should do, on its own input."""

import collections
import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixmill.llm import common, mixing, pii, rules
from helixmill.llm.common import table
from tests.llm.test_near_duplicates import brute as groups
from tests.llm.test_tokens import OWN

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents").withColumn("n_tokens", F.lit("clash"))
    columns = list(corpus_pipeline.COLUMNS)
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        rows_in, rows_out = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        if name == "quality rules":
            verdict = {r["doc_id"]: r["kept"] for r in rules.report(docs, rules.train(docs, table(spark, FOLDER, "labels"))).collect()}
            assert {r["doc_id"] for r in rows_out} == {i for i, k in verdict.items() if k}
        elif name == "near-duplicates":
            assert {r["doc_id"] for r in rows_out} == {i for i, _, c in groups([(r["doc_id"], r["text"]) for r in rows_in]) if i == c}
        elif name == "personal data":
            assert len(rows_out) == len(rows_in) and all(r["n_chars"] == len(r["text"]) for r in rows_out)
            assert pii.report(out).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
        else:
            taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.taken(docs).collect()}
            assert collections.Counter(r["doc_id"] for r in rows_out) == {i: n for i, n in taken.items() if n}
        counts.append(len(rows_out))
        docs = spark.createDataFrame([tuple(r.values()) for r in rows_out], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in last) == sorted((r["doc_id"], len(OWN.encode_ordinary(r["text"]))) for r in docs.collect())
    assert counts[0] >= counts[1] == counts[2] > 0
    assert corpus_pipeline.run(spark, FOLDER).count() == len(last)


LONG_ENOUGH = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "few words", "b"), (4, LONG_ENOUGH, "b"), (4, LONG_ENOUGH, "b"), (5, LONG_ENOUGH, None), (None, LONG_ENOUGH, "c"),
    (6, LONG_ENOUGH + " é🎉 mail a.b@c.de", "c"), (7, " ".join(f"w{i % 5000}x{i}" for i in range(120_000)) + " 10.0.0.1", "d"),
]


def texts_of(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages_on_edges(spark, documents):
    """Each stage's own result for nulls, empty, short and very long texts, repeated rows, a null id and clashing names."""
    docs = documents(ROWS)
    out = {name: stage(spark, docs, FOLDER) for name, stage in corpus_pipeline.STAGES}
    assert all(df.columns == list(corpus_pipeline.COLUMNS) for name, df in out.items() if name != "byte-level BPE")
    # No row of these is labelled, so the plain rules decide.
    assert texts_of(out["quality rules"].collect()) == sorted(((i, t) for i, t, _ in ROWS if t and len(t.split()) >= 50), key=str)
    kept = [r["doc_id"] for r in out["near-duplicates"].collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 4, None, 7], key=str)
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out["personal data"].collect()}
    assert masked[1] == (None, None) and masked[2] == ("", 0) and masked[6][0] == LONG_ENOUGH + " é🎉 mail [EMAIL]"
    assert masked[7][0] == ROWS[8][1][:-8] + "[IP]" and masked[7][1] == len(masked[7][0]) and masked[5][0] == LONG_ENOUGH
    times = collections.Counter((r["doc_id"], r["text"]) for r in out["source mix"].collect())
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.taken(docs).collect()}
    for i, t, _ in ROWS:
        size = len((t or "").split())
        assert taken[i][1] == size and (size == 0 or times[i, t] == taken[i][0] // size * (2 if i == 4 else 1))
    tokens = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out["byte-level BPE"].collect()}
    assert tokens == {(i, len(OWN.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS}


@pytest.mark.parametrize("at", range(5))
def test_stage_on_edges_and_nothing(spark, documents, edges, at):
    stage = corpus_pipeline.STAGES[at][1]
    stage(spark, documents(edges), FOLDER).collect()
    assert stage(spark, documents([]), FOLDER).count() == 0


def test_tables_go_once_results_are_taken(spark, documents):
    common.release()
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert len(set(os.listdir(root)) - before) < 12
    common.release()
    assert set(os.listdir(root)) <= before
