import collections
import re
import zlib

import numpy as np
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm import compression, queries, rules, trees
from helixmill.llm.common import table

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often = collections.Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t#|日  "), max_size=80))
def test_statistics(text):
    assert rules.statistics(text.encode())[0] == counted(text)


def test_rules_on_edges(spark, documents, edges):
    for forest in (None, trees.fit(np.random.default_rng(0).random((50, len(rules.FEATURES))), np.arange(50) % 2.0, np.array(list(rules.FEATURES.values())))):
        got = rules.report(documents(edges), forest).collect()
        assert sorted(((r["doc_id"], *(r[c] for c in rules.COUNTS)) for r in got), key=str) == sorted(((e[0], *counted(e[1])) for e in edges), key=str)
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert rules.report(documents([]), None).count() == 0
    docs = documents(edges)
    kept = rules.keep(docs, None)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [r["doc_id"] for r in rules.report(docs, None).where("kept").orderBy("doc_id").collect()]


def test_rules_learn(spark):
    got = queries.QUERIES["op7_quality_rules"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.98


def test_rules_without_labels(spark, documents, edges):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert rules.train(documents(edges), none) is None


def test_trees_keep_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(800)) > 0.7).astype(float)
    forest = trees.fit(x, y, np.array([1, 0, -1]))
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.9
    for feature, sign in ((0, 1), (2, -1)):
        rows = np.repeat(x[:40], 30, axis=0)
        rows[:, feature] = np.tile(np.linspace(0, 1, 30), 40)
        steps = np.diff(forest.margin(rows).reshape(40, 30), axis=1)
        assert (sign * steps >= -1e-12).all()
    none = trees.fit(x, y, np.zeros(3), trees=0)
    assert np.allclose(none.probability(x), y.mean())


def test_compression_on_held_out_rows(spark):
    got = queries.QUERIES["op5_compression_quality"](spark, FOLDER)
    rows = got.join(table(spark, FOLDER, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows if r["held_out"]]) > 0.93


def test_compression_edges(spark, documents, edges):
    docs = documents(edges)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert compression.train(docs, none) is None
    assert {r["score"] for r in compression.score(docs, None).collect()} == {0.5}
    labelled = documents([(i, f"good words number {i} stand here" if i % 2 else f"BAD!!! {i} $$$ &&& ###") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = compression.train(labelled, labels)
    got = compression.score(docs, model).collect()
    assert len(got) == len(edges) and all(0 <= r["score"] <= 1 for r in got)
    assert compression.score(documents([]), model).count() == 0
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1


def test_scores_use_text_alone(spark, documents):
    model = compression.Model(b"good text " * 50, b"$$$ ### " * 50, (0.0, 1.0))
    a = compression.score(documents([(1, "good text here", "a")]), model).first()["score"]
    assert a == compression.score(documents([(99, "good text here", "zz")]), model).first()["score"]
    assert compression.dictionary([b"few"]) == b"few"


def plain_score(text, model):
    """The score by the zstandard library, block by block, without anything shared."""
    data, total = (text or "").encode(), 0
    for start in range(0, len(data), compression.BLOCK):
        sizes = []
        for content in (model.good, model.bad):
            own = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
            sizes.append(len(own.compress(data[start : start + compression.BLOCK])))
        total += sizes[1] - sizes[0]
    return 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * 10 * (total / len(data) if data else 0))))


def test_scores_against_the_library(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = compression.train(docs, labels)
    assert len(model.weights) == 2 and model.weights[1] > 0
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 9 = 0").collect()}
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op5_compression_quality"](spark, FOLDER).collect()}
    assert all(abs(got[i] - plain_score(t, model)) < 1e-9 for i, t in texts.items()) and len(got) == docs.count()


def test_training_texts_are_bounded(spark, documents, monkeypatch):
    monkeypatch.setattr(compression, "TRAIN_BYTES", 5000)
    monkeypatch.setattr(compression, "LONGEST", 900)
    rows = [(i, f"{i} " + "w" * (100 + i)) for i in range(400)] + [(i, "y" * 1500) for i in range(400, 450)] + [(7, "7 second text")] * 3
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(450)], "doc_id bigint, quality int, toxic int")
    sample = compression.training_texts(documents(rows), labels)
    for quality in (0, 1):
        sizes = [len(t) for q, t in sample if q == quality]
        assert 3500 < sum(sizes) <= 5000 and max(sizes) <= 900
    assert all(q == int(t.split()[0]) % 2 and zlib.crc32(t.split()[0]) % 4 != 2 for q, t in sample)
    assert len(sample) == len({t.split()[0] for _, t in sample})
    assert sample == compression.training_texts(documents(rows, partitions=7), labels)


def walked(forest, x):
    """Probability of one row, tree by tree and node by node."""
    margin = forest.bias
    for root in forest.roots:
        at = int(root)
        while forest.left[at] != at:
            at = int(forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at])
        margin += forest.value[at]
    return 1 / (1 + np.exp(-margin))


def test_verdicts_against_a_walk(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    forest = rules.train(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = queries.QUERIES["op7_quality_rules"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        badness = walked(forest, rules.statistics(texts[r["doc_id"]])[1])
        assert abs(badness - r["badness"]) < 1e-9 and r["kept"] == (not r["base_failed"] and badness < rules.REJECT)


def test_repeated_labelled_rows_teach_once(spark, documents):
    rows = [(i, f"text {i} " * 30) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    x, y = rules.training_rows(documents(rows), labels)
    again = rules.training_rows(documents(rows + rows[:5] * 20, partitions=5), labels)
    assert (x == again[0]).all() and (y == again[1]).all() and len(x) == 40
