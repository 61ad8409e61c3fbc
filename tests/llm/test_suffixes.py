import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm import suffixes


def brute(rows):
    seen, out = set(), []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    shared = [letters(n) for n in (98, 99, 100, 101, 120, 180, 400, 1500)] + ["é" * 60 + "日本" * 30]
    rows = []
    for i in range(80):
        parts = [letters(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            if rng.random() < 0.4:  # a near copy
                at = rng.randrange(len(passage))
                passage = passage[:at] + rng.choice(["", "X", "yy"]) + passage[at + 1 :]
            parts += [passage, letters(rng.randrange(30))]
        if i % 9 == 0:
            parts += ["a" * rng.randrange(90, 300), "xy" * rng.randrange(40, 150), "\n" * rng.randrange(90, 220)]
        rows.append((i * 5, "".join(parts)))
    return [*rows, (7000, rows[3][1]), (7001, rows[3][1]), (7002, "Z" + rows[4][1])]


def check(documents, rows):
    got = suffixes.remove_repeats(documents(rows))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert sorted((tuple(r[:5]) + (bytes(r[5]),) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, documents, seed):
    check(documents, passages(seed))


def test_shuffled_joins_and_cut_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    monkeypatch.setattr(suffixes, "CROWD", 3)
    monkeypatch.setattr(suffixes, "CUT_BYTES", 500)
    suffixes.tables.cache_clear()
    check(documents, passages(4))
    suffixes.tables.cache_clear()


def test_edges(spark, documents, edges):
    check(documents, [(i, t[:60_000] if t else t, *r) for n, (i, t, *r) in enumerate(edges) if n != 5])
    check(documents, [])
    twice = "".join(random.Random(1).choices("abcdef", k=150))
    got = suffixes.remove_repeats(documents([(1, twice), (1, twice), (2, twice), (None, twice)]), texts=False).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in got), key=str) == sorted([(1, 0), (1, 0), (2, 150), (None, 150)], key=str)


@pytest.mark.parametrize("crowd", [1, 4096])
def test_repeated_rows_are_one_document(spark, documents, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    a, b, c = ("".join(random.Random(i).choices("abcdef", k=90)) for i in range(3))
    rows = [(1, a + b + c), (2, a + b + "." + c), (3, "." + a + b), (4, b + c)]
    got = suffixes.remove_repeats(documents(rows + rows[:3])).collect()
    assert sorted({tuple(r[:5]) + (bytes(r[5]),) for r in got}, key=str) == brute(rows) and len(got) == 7


def test_long_text_is_taken_whole(spark, documents):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghij ", k=700_000))
    got = {r["doc_id"]: tuple(r)[1:4] for r in suffixes.remove_repeats(documents([(1, long), (2, "-" + long[:-1] + "-"), (3, "é" + long[300_000:300_100])]), texts=False).collect()}
    assert got == {1: (700_000, 0, 0), 2: (700_001, 699_999, 1), 3: (102, 100, 1)}


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=100, max_size=220), st.binary(max_size=90), st.binary(max_size=90), st.binary(max_size=90), st.binary(max_size=90))
def test_equal_windows_have_equal_ranks(core, a, b, c, d):
    """The stretches of two texts give the windows of their common part equal names at equal distances."""
    one, other = a + core + b, c + core + d
    data = np.frombuffer(one + other, np.uint8)
    start, n, anchor, name = suffixes.chunk_stretches(data, np.array([len(one), len(one) + len(other)]))
    at = {int(s) + i: (int(x) - int(s) - i, int(h)) for s, k, x, h in zip(start, n, anchor, name) for i in range(k)}
    assert sorted(at) == [*range(len(one) - 99), *range(len(one), len(one) + len(other) - 99)]
    for i in range(len(core) - 99):
        assert at[len(a) + i] == at[len(one) + len(c) + i]
