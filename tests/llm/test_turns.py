import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from helixmill.llm import turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = text.strip(SPACE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least (cost, audit, repaired turns) by search over whole edit sequences with memo of all."""
    follows = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    best = {}
    heap = [(0, "", 0, "", ())]
    import heapq

    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in best:
            continue
        best[i, last] = True
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        for role in ("user", "assistant"):
            if role[0] in follows[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*out, f"{role}:")))
                if i < len(rows) and faults[i] in ("", "truncated"):
                    heapq.heappush(heap, (cost + 2 + (faults[i] == "truncated"), audit + "R", i + 1, role[0], (*out, f"{role}:{rows[i][3]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if faults[i] in ("", "truncated") and rows[i][2][:1] in follows[last] and rows[i][2]:
                heapq.heappush(heap, (cost + (faults[i] == "truncated"), audit + "K", i + 1, rows[i][2][0], (*out, f"{rows[i][2]}:{rows[i][3]}")))


def brute(rows, every=None):
    held = collections.defaultdict(list)
    for row in rows:
        held[row[0]].append((*row[:2], " " if row[2] is None else row[2], " " if row[3] is None else row[3]))
    out = []
    for conv in every if every is not None else held:
        own = ordered(held.get(conv, []))
        faults, at = faults_of(own), [r[1] for r in own if r[1] is not None]
        cost, audit, lines = cheapest(own, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        roles = [rng.choice(["user", "assistant", "system", "", "unknown", "tool", None]) if rng.random() < 0.3 else ("user", "assistant")[t % 2] for t in range(rng.choice([1, 2, 5, 9, 40]))]
        for t, role in enumerate(roles):
            if rng.random() < 0.9:
                rows.append((c if c else None, rng.choice([t, t, t, t // 2, None]) if c % 3 == 0 else t, role, rng.choice(["Well.", "Well, it is so.", "cut off", "", " \t", "Why?  ", None, "é!", "ends "])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("at", "first", "segment", "fault", "initial", "one", "range", "kind", "audit", "state", "cost", "copy", "damage")})


@pytest.mark.parametrize("seed,piece", [(1, 4096), (2, 7), (3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(turns, "PIECE", piece)
    rows = talks(seed)
    got = turns.report(frame(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_damage(spark):
    rows = talks(5) + [(500 + i, i, "user", "Here.") for i in range(40)]
    got = turns.damage_report(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(damage(rows), {r[0] for r in rows})


def test_repaired_turns(spark):
    rows = talks(6, 20)
    lines = collections.defaultdict(list)
    for r in sorted(turns.repair(frame(spark, rows)).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        assert r["place"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, *_, digest in brute(rows):
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == digest


def test_edges(spark):
    long = "word " * 300_000 + "."
    for rows in ([], [(None, None, None, None)], [(1, 0, "user", long), (1, 1, "assistant", long[:-1]), (1, 1, "assistant", long[:-1])], [(7, 2**63 - 1, "system", "One."), (7, 0, "user", "Two.")], [(3, None, "user", "A."), (3, None, "user", "A."), (3, 4, "user", "A.")]):
        got = turns.report(frame(spark, rows))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
        assert turns.damage_report(frame(spark, rows)).count() == len({r[0] for r in rows})
