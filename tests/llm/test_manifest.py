import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from helixmill.llm import merkle
from helixmill.llm.merkle import Forest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    """All levels of a tree, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    trees = collections.defaultdict(list)
    for row in rows:
        trees[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for t, s in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            siblings = []
            for levels, at in ((built[s], i), (top, t)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    siblings.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
                    at //= 16
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of((*row[:4], text))
            for left, right in siblings:
                node = h(left + node + right)
            out.append((row[0], leaf, built[s][-1][0], top[-1][0], h("".join(a + b for a, b in siblings)), node, node == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("clash") for c in ("leaf", "tree", "place", "key", "path", "root", "one", "range", "at")})
    got = merkle.report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed,segment,fan", [(1, 50, 3), (2, 7, 2), (3, 4096, 64)])
def test_against_brute_force(spark, monkeypatch, seed, segment, fan):
    monkeypatch.setattr(merkle, "SEGMENT", segment)
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = random.Random(seed)
    sources = [None, "", "b", "a", "é", "Z", *(f"s{i}" for i in range(20))]
    rows = [(i * 3 - 50, "hot" if i % 3 == 0 else rng.choice(sources), rng.choice(["en", None]), i, rng.choice(["Some TEXT", "no capitals", None, ""]) if i % 2 else f"Row {i}") for i in range(700)]
    check(spark, rows + rows[:20])


def test_edges(spark, edges):
    check(spark, [(r[0], r[2] if len(r) > 2 else None, None, None, r[1]) for r in edges])
    check(spark, [(5, None, None, None, None)])
    check(spark, [(i, "one", "en", 1, "A") for i in (0, -(2**63), 2**63 - 1, None)])
    check(spark, [(i, f"s{i}", "en", 1, "A") for i in range(300)])
    empty = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.report(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 300])
def test_any_order_of_merging_gives_one_forest(n):
    """Fragments of random shares of the leaves, merged in random order, against the tree of all at once."""
    rng, leaves = random.Random(n), [h(str(i)) for i in range(n)]
    want = levels_of([levels_of(leaves)[-1][0], h("other")])[-1]
    for _ in range(5):
        done = collections.Counter()
        parts = [Forest(2, lambda *row: done.update([row])) for _ in range(4)]
        for i in rng.sample(range(n), n):
            parts[rng.randrange(4)].add(0, 0, i, n, leaves[i])
        parts[rng.randrange(4)].add(1, 0, 0, 1, h("other"))
        while len(parts) > 1:
            a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
            for node in b.nodes():
                a.add(*node)
            parts.append(a)
        assert [x[4] for x in parts[0].nodes()] == want and max(done.values()) == 1
