import hashlib
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from helixmill.llm import queries, simhash
from helixmill.llm.common import table


def with_next(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(r, rows[(i + 1) % len(rows)]) for i, r in enumerate(rows)]


def test_against_the_fingerprints_of_edited_texts(spark, documents):
    rng = random.Random(5)
    rows = [(i * 3, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(rng.randrange(0, 90)))) for i in range(70)] + [(1000, None), (1001, ""), (1002, "x" * 500 + " é 🎉")]
    edited = {}
    for (doc_id, text, *_), (_, after, *_) in with_next(rows):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited[doc_id] = text[: len(text) - k] + after[:k]
    for partitions in (1, 6):
        got = {r["doc_id"]: r for r in simhash.compare_edited(documents(rows, partitions=partitions)).collect()}
        assert set(got) == {r[0] for r in rows}
        both = spark.createDataFrame([(i, r[1] or "") for i, r in enumerate(rows)] + [(1000 + i, edited[r[0]]) for i, r in enumerate(rows)], "doc_id bigint, text string")
        prints = {r["doc_id"]: r["h"] for r in simhash.fingerprints(both).select("doc_id", simhash.in_hex(F.col("fingerprint")).alias("h")).collect()}
        follow = {r[0]: n[0] for r, n in with_next(rows)}
        place = {r[0]: i for i, r in enumerate(rows)}
        for i, r in enumerate(rows):
            g = got[r[0]]
            assert g["n_chars"] == len(r[1] or "") and g["edited_sha256"] == hashlib.sha256(edited[r[0]].encode()).hexdigest()
            assert (g["fingerprint"], g["edited_fingerprint"]) == (prints[i], prints[1000 + i])
            after = prints[place[follow[r[0]]]]
            bits = bin(int(g["fingerprint"], 16) ^ int(after, 16)).count("1")
            assert abs(g["near_next"] - max(0, __import__("math").cos(__import__("math").pi * bits / 64))) < 1e-9


def brute_fingerprint(spark, text):
    words = text.lower().split()
    pairs = [(w, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h"), F.least(F.length("a") + F.coalesce(F.length("b"), F.lit(0)), F.lit(16)).alias("w")).collect()
    votes = [sum(r["w"] if (r["h"] >> i) & 1 else -r["w"] for r in rows) for i in range(64)]
    return f"{sum(1 << i for i, v in enumerate(votes) if v > 0):016x}"


def test_votes(spark, documents):
    texts = ["one", "The quick brown fox jumps over the lazy dog the quick", " ".join(f"w{i % 40}" for i in range(900))]
    got = {r["doc_id"]: r["h"] for r in simhash.fingerprints(documents(list(enumerate(texts)))).select("doc_id", simhash.in_hex(F.col("fingerprint")).alias("h")).collect()}
    assert got == {i: brute_fingerprint(spark, t) for i, t in enumerate(texts)}


def test_edges(spark, documents, edges):
    got = simhash.compare_edited(documents(edges)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(e[0]), len(e[1] or "")) for e in edges)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}) == 1 and len({r["fingerprint"] for r in got if r["doc_id"] in (8, 9)}) == 1
    assert simhash.compare_edited(documents([])).count() == 0
    one = simhash.compare_edited(documents([(1, "abc def ghi")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abc def abc").hexdigest()


def test_near_finds_all_within_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    some = [b ^ sum(1 << i for i in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4, 5)] + base[:5]
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    table = spark.createDataFrame([(x,) for x in signed], "fingerprint bigint")
    queries = spark.createDataFrame([(x,) for x in signed[::7]], "fingerprint bigint")
    got = {(r["query"], r["fingerprint"]): r["distance"] for r in simhash.near(table, queries).collect()}
    want = {(a, b): d for a, b in itertools.product(set(signed[::7]), set(signed)) if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 3}
    assert got == want


def test_next_of_the_least_number_and_null(spark, documents):
    rows = [(-(2**63), "the least number"), (None, "no number at all"), (4, "four"), (-(2**63), "least again")]
    for partitions in (1, 3):
        got = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in simhash.compare_edited(documents(rows, partitions=partitions)).collect()}
        line = ["four", "the least number", "least again", "no number at all"]
        want = {len(a): hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest() for a, b in zip(line, line[1:] + line[:1])}
        assert {n: h for (_, n), h in got.items()} == want


def in_few_buckets(n, seed, free):
    """Fingerprints that differ in some of the lowest ``free`` bits alone."""
    rng = random.Random(seed)
    found = set()
    while len(found) < n:
        found.add(0x9E3779B97F4A7C15 >> 1 ^ sum(1 << i for i in rng.sample(range(free), rng.randrange(free))))
    return sorted(found)


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 16)
    for radius, blocks in ((3, 6), (2, 4)):
        some = in_few_buckets(700, 3, 34)
        rows = spark.createDataFrame([(x,) for x in some], "fingerprint bigint")
        queries = rows.where("fingerprint % 3 = 0").unionByName(spark.createDataFrame([(some[0] ^ 1 << 60,), (None,)], "fingerprint bigint"))
        taken = simhash.near(rows, queries, radius, blocks).collect()
        got = {(r["query"], r["fingerprint"], r["distance"]) for r in taken}
        asked = {x for x in some if x % 3 == 0} | {some[0] ^ 1 << 60}
        assert len(got) == len(taken) and got == {(a, b, d) for a in asked for b in some if (d := (a ^ b).bit_count()) <= radius}


def test_crowded_buckets_do_not_pair_all(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 64)
    some = in_few_buckets(4000, 4, 34)
    rows = spark.createDataFrame([(x,) for x in some], "fingerprint bigint")
    # What one level of tables would pair: measured, 5,046,878 against 1,507,062.
    one_level = sum(c * c for mask in simhash.Level(64, 3, 6).masks for c in Counter(x & mask for x in some).values())
    assert 3 * simhash.candidates(rows, rows).count() < one_level


def test_near_query_searches_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    prints = {r["doc_id"]: int(r["h"], 16) for r in simhash.fingerprints(table(spark, folder, "documents")).select("doc_id", simhash.in_hex(F.col("fingerprint")).alias("h")).collect()}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["n_near"]) for r in queries.QUERIES["op9_fingerprints"](spark, folder).collect()}
    assert got == {i: (p, sum((p ^ q).bit_count() <= 3 for q in set(prints.values()))) for i, p in prints.items()}
