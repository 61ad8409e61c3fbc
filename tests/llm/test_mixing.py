import collections

import pytest

from helixmill.llm import mixing


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    total = sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] for s in capped} | share
        capped |= over


def rows_of(*counts):
    out, at = [], 0
    for i, n in enumerate(counts):
        for j in range(n):
            out.append((at, " ".join(["w"] * (1 + (at * 7 + j) % 30)), None if i == 2 else f"s{i}"))
            at += 1
    return out


@pytest.mark.parametrize("counts", [(400, 300, 200, 20), (5, 800, 3, 600, 90), (50,)])
def test_targets_and_taken(spark, documents, counts):
    rows = rows_of(*counts)
    got = mixing.taken(documents(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    source = {r[0]: r[2] for r in rows}
    sizes, taken, aim = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        aim[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert aim == pytest.approx(targets(sizes))
    assert all(abs(taken[s] - aim[s]) <= 30 for s in sizes)
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)
    again = mixing.taken(documents(rows, partitions=7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_edges(spark, documents, edges):
    got = mixing.taken(documents(edges)).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(e[0]), len((e[1] or "").encode().split())) for e in edges)
    assert mixing.taken(documents([])).count() == 0
    assert mixing.taken(documents([(1, None, None), (2, "", "x")])).where("taken <> 0 OR target <> 0").count() == 0


def test_thresholds_nest(spark, documents):
    rows = rows_of(300, 300)
    few = {r["doc_id"]: r["taken"] for r in mixing.taken(documents(rows), weights=(5, 5)).collect()}
    more = {r["doc_id"]: r["taken"] for r in mixing.taken(documents(rows), weights=(6, 4)).collect()}
    assert all(more[i] >= few[i] for i, *_, s in rows if s == "s0")


def test_mix_repeats_rows(spark, documents):
    rows = rows_of(30, 300, 4)
    docs = documents(rows)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.taken(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in want.items() if n}
    assert mixing.mix(documents([])).count() == 0
