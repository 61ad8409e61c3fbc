import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixmill.llm import bpe, records, token_counts
from helixmill.llm.pieces import byte_table, codec, read_ranks, splitter, to_bytes, to_chars

MULTI, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(MULTI), special_tokens={})
LIBRARY = Tokenizer.from_file(JSON)
ODD = ["", " ", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "x" * 4000, "ab" * 3000, " \n\n \t x  ", "日本語🎉é̂", "\x00\x1c\x85  　z", "'s 'll don't 12²½ Ⅷ"]


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_codecs_equal_the_libraries(text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(codec(MULTI, public_tokenizers.PATTERN).packed(text)) == OWN.encode_ordinary(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(codec(JSON, public_tokenizers.PATTERN).packed(text)) == want
    assert token_counts.counter(JSON, public_tokenizers.PATTERN).count(text) == len(want)


def test_odd_texts_and_code_points():
    for text in [*ODD, *(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}! {chr(c)}" for c in range(0, 0x11000, 3) if not 0xD800 <= c < 0xE000)]:
        assert ids(codec(MULTI, public_tokenizers.PATTERN).packed(text)) == OWN.encode_ordinary(text)
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids(codec(JSON, public_tokenizers.PATTERN).packed(text)) == want
        assert token_counts.counter(JSON, public_tokenizers.PATTERN).count(text) == len(want)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=50))
def test_ascii_split(text):
    assert splitter(public_tokenizers.PATTERN)(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_byte_table():
    assert len(set(byte_table())) == 256 and to_bytes(to_chars(bytes(range(256)))) == bytes(range(256))


def test_encode_decode(spark, documents, edges):
    rows = [*edges, *((100 + i, t) for i, t in enumerate(ODD))]
    got = bpe.digests(documents(rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()

    def want(r):
        own = OWN.encode_ordinary(r[1] or "")
        return r[0], len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted(map(want, rows), key=str)
    assert bpe.digests(documents([])).count() == 0


def test_offsets_and_split_characters(spark, documents):
    text = "naïve 🎉🎉 日本 x"
    row = bpe.encode(documents([(1, text)])).first()
    data = [read for read in (OWN.decode_single_token_bytes(i) for i in row["ids"])]
    at = 0
    for piece, start, end in zip(data, row["starts"], row["ends"], strict=True):
        assert text[start:end].encode().find(piece) >= 0
        assert len(text[:start].encode()) <= at and at + len(piece) <= len(text[:end].encode())
        at += len(piece)
    halves = spark.createDataFrame([(1, OWN.encode_ordinary("🎉")[:1]), (2, OWN.encode_ordinary(text)), (3, None)], "doc_id bigint, ids array<int>")
    out = {r["doc_id"]: r["t"] for r in bpe.decode(halves).select("doc_id", bpe.decoded_text(F.col("decoded")).alias("t")).collect()}
    assert out[2] == text and out[3] == "" and set(out[1]) == {"�"}


def test_counts(spark, documents, edges):
    rows = [*edges, *((100 + i, t) for i, t in enumerate(ODD))]
    got = token_counts.count_tokens(documents(rows)).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(LIBRARY.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(documents([])).count() == 0


def test_record_files(spark, documents, edges):
    least = (-(2**63), "the least number of all")
    rows = [*edges, least, *((100 + i, t) for i, t in enumerate(ODD))]
    encoded = {r[1]: [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(encoded[r[1]], "<u2").tobytes()))
    manifest = records.write_records(documents(rows), shards=4)
    got = records.read_records(manifest).collect()
    start, want = 0, []
    for doc_id, text, *_ in rows:
        own = encoded[text]
        want.append((doc_id, start, len(own), np.array(own, "<u4").tobytes()))
        start += len(own)
    assert sorted([(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got], key=lambda r: r[1]) == want
    shuffled = records.read_shuffled(manifest, 7, 3).collect()
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in shuffled) == sorted((str(w[0]), w[3]) for w in want)
    assert [r["doc_id"] for r in shuffled] != [w[0] for w in want]
    index = records.read_index(manifest).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in index) == sorted((str(w[0]), w[2]) for w in want) and min(r["offset"] for r in index) == 0
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in records.digests(documents(rows)).collect()}
    assert digest == {(w[0], w[1]): zlib.crc32(w[3]) for w in want}
    records.remove(spark, manifest)
    with pytest.raises(Exception):
        records.read_records(manifest).collect()


def test_record_files_of_nothing(spark, documents):
    assert records.digests(documents([])).count() == 0


def test_frames_are_checked():
    import io

    good = records.frame(b"abc") + records.frame(b"")
    assert list(records.frames(io.BytesIO(good))) == [b"abc", b""]
    for at in (0, 9, 13, 16):
        with pytest.raises(ValueError):
            list(records.frames(io.BytesIO(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])))


def spans(text, tokens):
    """Start and end code point of tokens (bytes) of a text."""
    at_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    ends = np.cumsum([0, *map(len, tokens)])
    return [(at_byte[a], at_byte[b - 1] + 1) for a, b in zip(ends[:-1], ends[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_offsets_are_the_librarys(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in [*texts, *ODD]]
    rows, counts = codec(JSON, public_tokenizers.PATTERN, offsets=True).placed(texts)
    want = [LIBRARY.encode(t, add_special_tokens=False) for t in texts]
    assert counts.tolist() == [len(w.ids) for w in want]
    assert [tuple(r) for r in rows.tolist()] == [(i, *o) for w in want for i, o in zip(w.ids, w.offsets)]
    own = codec(MULTI, public_tokenizers.PATTERN, offsets=True)
    rows, counts = own.placed(texts)
    tokens = [[OWN.decode_single_token_bytes(i) for i in OWN.encode_ordinary(t)] for t in texts]
    assert [tuple(r) for r in rows[:, 1:].tolist()] == [x for t, b in zip(texts, tokens) for x in spans(t, b)]
    assert own.decoded(rows[:, 0]) == [b for t in tokens for b in t] and own.decoded(np.array([-1, 10**9])) == [b"", b""]


def test_digest_of_offsets(spark, documents, edges):
    rows = [*edges, *((100 + i, t) for i, t in enumerate(ODD))]
    got = {(r["doc_id"], r["ids_sha256"]): (r["n_split"], r["offsets_crc32"]) for r in bpe.digests(documents(rows)).collect()}
    for doc_id, text, *_ in rows:
        ids = OWN.encode_ordinary(text or "")
        tokens = [OWN.decode_single_token_bytes(i) for i in ids]
        placed = spans(text or "", tokens)
        crc = zlib.crc32(np.array([s[0] for s in placed] + [s[1] for s in placed], "<u4").tobytes())
        assert got[doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] == (sum(b[0] < a[1] for a, b in zip(placed, placed[1:])), crc)


def test_a_pattern_that_leaves_text_out():
    own = codec(MULTI, r"[a-z]+", offsets=True)
    rows, _ = own.placed(["12 ab é cd!"])
    assert [("12 ab é cd!"[a:b]) for _, a, b in rows.tolist()] and "".join("12 ab é cd!"[a:b] for _, a, b in rows.tolist()) == "abcd"


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}, {"type": "Whitespace"}])
def test_other_splits_are_refused(tmp_path, change):
    import json

    with open(JSON, encoding="utf-8") as file:
        spec = json.load(file)
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} | change
    if change.get("type"):
        spec["pre_tokenizer"] = change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    for make in (codec, token_counts.counter):
        with pytest.raises(ValueError):
            make(str(path), public_tokenizers.PATTERN)
