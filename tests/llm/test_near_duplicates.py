import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import minhash, shingles
from helixmill.llm.common import Scratch
from helixmill.llm.components import connected_components
from tests.llm.conftest import EDGES


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """(n_shingles, component) by row."""
    sets = [shingle_set(r[1]) for r in rows]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        met = collections.Counter(j for x in s for j in at[x])
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
        for x in s:
            at[x].append(i)
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0]) if s else r[0]) for r, s in zip(rows, sets)), key=str)


def near_copies(n, seed, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        rate = rng.choice([0, 0.01, 0.03, 0.06, 0.1, 0.3])
        out.append(" ".join(w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in base))
    return out


def check(spark, documents, rows):
    got = minhash.near_duplicates(documents(rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_edges(spark, documents, edges):
    check(spark, documents, edges)


def test_empty(spark, documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    assert minhash.deduplicated(documents([])).count() == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_against_brute_force(spark, documents, monkeypatch, hot):
    """Small buckets, and with a low limit the hubs and prefixes of large ones."""
    monkeypatch.setattr(minhash, "HOT", hot)
    texts = near_copies(60, 1) + near_copies(25, 2) + ["copy of a text that stands here many times over"] * 30 + [f"alone {i} " * 3 for i in range(40)]
    random.Random(3).shuffle(texts)
    check(spark, documents, [(i * 7 - 100, t) for i, t in enumerate(texts)])


def test_stage_keeps_one_of_each_group(spark, documents, edges):
    docs = documents(edges)
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([1, 2, 3, 4, 5, 5, None, 7, 8, 10, 11, 12, 12], key=str)
    assert sorted(r["text"] for r in got.where("doc_id = 12").collect()) == ["", EDGES[-4][1]]


def loses_no_text(rows, kept):
    """Each text has an equal or linked one among those that stay."""
    sets = [shingle_set(t) for _, t in kept]
    for _, text in rows:
        s = shingle_set(text)
        assert any(100 * len(s & t) >= 75 * len(s | t) for t in sets) or not s, text


def test_documents_of_several_texts(spark, documents):
    """Rows that share a doc_id and have different texts, chained through others: components by brute force, no text lost."""
    a, b, c, d = ("text number %s of four that have not one run of five words in common" % i for i in ("one and a", "two by b", "three c c", "iv"))
    a, b, c, d = (" ".join(w + str(i) for w in t.split()) for i, t in enumerate((a, b, c, d)))
    for rows in (
        [(3, a), (5, a), (5, b), (7, b)],
        [(5, a), (5, b), (7, a), (4, d), (9, b), (4, b + " more"), (9, c)],
        [(1, a), (1, b), (1, a), (2, b), (2, a), (3, "")],
        [(i % 7, t) for i, t in enumerate(near_copies(40, 8) + near_copies(20, 9))],
    ):
        check(spark, documents, rows)
        kept = [(r["doc_id"], r["text"]) for r in minhash.deduplicated(documents(rows)).collect()]
        if len(rows) < 10:
            loses_no_text(rows, kept)
        assert len(kept) <= len(rows) and {i for i, _ in kept} <= {i for i, _ in rows}


@pytest.mark.parametrize("n", [1, 5, 40, 3000])
def test_sketch_estimates_similarity(n):
    rng = np.random.default_rng(n)
    common, own = rng.integers(0, 2**63, 3 * n).astype(np.uint64), rng.integers(0, 2**63, 2 * n).astype(np.uint64)
    a, b = np.append(common, own[:n]), np.append(common, own[n:])
    sketch = shingles.similarity_sketch(np.concatenate([a, b]), np.array([len(a), len(b)]), 2048)
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (95, 100), (7, 7), (200, 201)]
    scratch = Scratch(spark)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), scratch).collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint"), scratch).count() == 0
    scratch.drop()


def template(n, seed, shared=72, own=28, group=1):
    """Pages of one template, each with words of its own that ``group`` neighbours have too."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10**6)}" for _ in range(shared)]
    out = []
    for i in range(n):
        if i % group == 0:
            body = [f"o{rng.randrange(10**9)}" for _ in range(own)]
        out.append(" ".join([*base, *body[:-1], body[-1] if group == 1 else f"l{i}"]))
    return out


def families(seed):
    """Templates whose pages link never, sometimes and nearly always, with small families inside."""
    out = []
    for shared in (60, 76, 84, 90):
        out += template(40, seed + shared, shared, 100 - shared)
        out += template(40, seed + 1000 + shared, shared, 100 - shared, 4)
    return out + near_copies(60, seed) + [t for s in (1, 2, 3) for t in near_copies(12, seed + s, 30)]


@pytest.mark.parametrize("hot,seed", [(3, 1), (8, 2), (64, 3)])
def test_templates_against_brute_force(spark, documents, monkeypatch, hot, seed):
    monkeypatch.setattr(minhash, "HOT", hot)
    texts = families(seed)
    random.Random(seed).shuffle(texts)
    check(spark, documents, list(enumerate(texts)))


@pytest.mark.parametrize("few", [500_000, 10])
def test_prefix_filter_loses_no_pair(spark, monkeypatch, few):
    """Prefix pairs of sets against all pairs, every set a star of its own; tokens given to the tasks or joined."""
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(5)
    sets = {}
    for i in range(160):
        base = np.arange(40) + 1000 * (i % 4)
        n = int(rng.integers(1, 41))
        sets[i] = sorted(int(x) for x in np.where(rng.random(n) < 0.1, rng.integers(10**4, 10**5, n), base[:n]))
    rows = [(i, len(set(s)), bytes(np.array(sorted(set(s)), "<i8").tobytes())) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "id bigint, n bigint, set binary")
    scratch = Scratch(spark)
    first = minhash.prefixes(table.select("id", "n"), table.select("id", "set"), scratch)
    pairs = minhash.prefix_pairs(first, table.select("id", F.col("id").alias("star")), scratch)
    found = {(min(r), max(r)) for r in minhash.confirmed(pairs, table.select("id", "set")).collect()}
    as_sets = {i: set(s) for i, s in sets.items()}
    want = {(i, j) for i in as_sets for j in as_sets if i < j and 100 * len(as_sets[i] & as_sets[j]) >= 75 * len(as_sets[i] | as_sets[j])}
    assert found == want and len(want) > 50 and pairs.count() < 160 * 159 // 2
    scratch.drop()


def test_work_grows_with_a_template(spark, documents, monkeypatch):
    """Rows that are formed for pages of one template, about 0.55 alike and linked to none, with pairs of pages inside."""
    formed = []

    def counted(name):
        function = getattr(minhash, name)

        def run(rows, *others):
            out = function(rows, *others)
            formed.append((out if name == "prefixes" else rows).count())
            return out

        monkeypatch.setattr(minhash, name, run)

    counted("pair_counts")
    counted("prefixes")
    total = []
    for n in (1000, 4000, 12000):
        formed.clear()
        rows = minhash.near_duplicates(documents(list(enumerate(template(n, 9, 71, 29, 2))))).agg(F.count_if("kept"), F.count_if(F.col("component_id") == F.col("doc_id") - F.col("doc_id") % 2)).first()
        assert tuple(rows) == (n // 2, n)
        total.append(sum(formed))
    assert total[1] <= 5 * total[0] and total[2] <= 15 * total[0], total


def modular(n, seed=3, modules=40, share=0.8):
    """Pages put together from shared modules, so that no shingle is rare."""
    rng = random.Random(seed)
    parts = [" ".join(f"m{i}x{j}" for j in range(40)) for i in range(modules)]
    return [" ".join(p for p in parts if rng.random() < share) for _ in range(n)]


def test_modular_pages(spark, documents, monkeypatch):
    """Nearly all pages share all first shingles; stars that have merged are not paired inside, so few of all pairs are tested."""
    tested, plain = [], minhash.pair_counts

    def counted(pairs, sets):
        tested.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(minhash, "pair_counts", counted)
    rows = list(enumerate(modular(400)))
    check(spark, documents, rows)
    assert sum(tested) < 0.75 * 400 * 399 / 2, tested
