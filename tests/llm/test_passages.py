import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm import recompression
from helixmill.llm.shingles import word_hashes


def brute(rows, window=20):
    """Rows in order of doc_id; removed words by row."""
    seen, out = set(), []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = bytearray(len(words))
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    shared = [[word() for _ in range(n)] for n in (18, 19, 20, 21, 25, 60, 200)]
    rows = []
    for i in range(120):
        parts = [[word() for _ in range(rng.randrange(40))]]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), [word() for _ in range(rng.randrange(30))]]
        if i % 9 == 0:
            parts += [["same"] * rng.randrange(1, 70), ["a", "b"] * rng.randrange(1, 30), ["x"] * rng.randrange(20, 50)]
        rows.append((i * 5, " ".join(w for p in parts for w in p)))
    return rows + [(7000, rows[3][1]), (7001, rows[3][1]), (7002, "UPPER " + rows[4][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, documents, seed):
    rows = passages(seed)
    got = recompression.remove_repeats(documents(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_shuffled_attachment(spark, documents, monkeypatch):
    monkeypatch.setattr(recompression, "BROADCAST_ROWS", 0)
    rows = passages(4)
    assert sorted(map(tuple, recompression.remove_repeats(documents(rows)).collect())) == sorted(brute(rows))


def test_edges(spark, documents, edges):
    rows = [e for i, e in enumerate(edges) if i != 5]  # the repeated row is told apart below
    got = recompression.remove_repeats(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert recompression.remove_repeats(documents([])).count() == 0
    twice = " ".join(f"w{i}" for i in range(30))
    got = recompression.remove_repeats(documents([(1, twice), (1, twice), (2, twice)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 30)]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=20, max_size=40), st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
def test_equal_windows_pick_equal_symbols(core, a, b, c, d):
    texts = [" ".join(a + core + b).encode(), " ".join(c + core + d).encode()]
    words, counts = word_hashes(texts, lower=False)
    chosen, _, text, place = recompression.picks(words, counts)
    for i in range(len(core) - 19):
        one = chosen[(text == 0) & (place == len(a) + i)]
        other = chosen[(text == 1) & (place == counts[0] + len(c) + i)]
        assert len(one) == len(other) == 1 and np.array_equal(one, other)
