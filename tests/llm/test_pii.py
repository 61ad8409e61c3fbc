import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.llm import pii

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(documents, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in pii.report(documents(rows)).collect()}
    for i, text in rows:
        want = base(text or "")
        listed = [tuple(x.split(":")) for x in got[i]["spans"].split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in listed if k in pii.BASE] == want, text
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want) for k in pii.BASE]


TEXTS = [
    None, "", "a@b.c a@b.c_d@e.f x@@y.z a@b a.@-.-", "é a@b.co 🎉 c@d.e.f.", "￿ a@b.c ￾￿ 1.2.3.4",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 12345678901234567890.1.1.1", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-",
    "1 4111 1111 1111 1111", "12  4111111111111111 x4111111111111111y", "+49 30 1234567 +1 (171) 555-2028 +1 12 +123456789012345678 +1-+1 234 567 890",
    "9" * 30_000, "1 " * 20_000, "a." * 20_000 + "@", "a@" + "b." * 20_000 + "c", "+1" + " (" * 20_000 + "2", "1." * 20_000,
]


def test_base_spans(spark, documents):
    check(documents, TEXTS)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1234567890@.-+ ()_é￿"), max_size=60), min_size=60, max_size=60))
def test_base_spans_property(spark, documents, texts):
    check(documents, [*texts, *("+" + t for t in texts), *(t.replace("@", "1").replace("é", "11") for t in texts)])


@pytest.mark.parametrize("text,kinds", [
    ("Pay to account DE89 3704 0044 0532 0130 00 now", ["iban"]), ("IBAN GB82WEST12345698765432", ["iban"]), ("DE89 3704 0044 0532 0130 01", []),
    ("my SSN is 123-45-6789", ["ssn"]), ("order 123-45-6789", []), ("ssn 000-45-6789", []), ("number 123-45-6789", []),
    ('token = "0b96a8c8d79c4a5085c919698889f59b72ab7bff"', ["secret"]), ("password: swordfishswordfish", []), ("a token of thanks", []),
])
def test_scored_kinds(spark, documents, text, kinds):
    spans = pii.report(documents([(1, text)])).first()["spans"]
    assert [x.split(":")[0] for x in spans.split(",") if x and x.split(":")[0] in pii.SCORED] == kinds


def test_edges_and_redaction(spark, documents, edges):
    docs = documents(edges)
    assert pii.report(docs).count() == len(edges) and pii.report(documents([])).count() == 0
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[10] == "<|endoftext|> mail me at [EMAIL] or [PHONE], card [CARD], ip [IP]."
    assert rows[1] is None and rows[2] == "" and rows[8] == dict((e[0], e[1]) for e in edges)[8]
    odd = {r["doc_id"]: r["text"] for r in pii.redact(documents([(1, "+4111 1111 1111 1111 é"), (2, "1.2.3.4"), (3, "a@b.c 1.2.3.4 🎉 a@b.c")])).collect()}
    assert odd[2] == "[IP]" and odd[3] == "[EMAIL] [IP] 🎉 [EMAIL]" and odd[1].endswith("] é") and "1111" not in odd[1]


def spans_of(documents, texts, kind):
    """For each text the matched strings of a kind."""
    rows = {r["doc_id"]: r["spans"].split(",") for r in pii.report(documents(list(enumerate(texts)))).collect()}
    listed = {i: [x.split(":") for x in spans if x.startswith(kind + ":")] for i, spans in rows.items()}
    return [[text[int(a) : int(b)] for _, a, b in listed[i]] for i, text in enumerate(texts)]


DE, DE_BLANKS, GB = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
IBANS = [
    (f"IBAN {GB} Please pay", [GB]), (f"IBAN {DE} BIC COBADEFFXXX", [DE]), (f"{DE_BLANKS} The", [DE_BLANKS]), (f"iban {DE} 2024 invoice", [DE]),
    (f"é🎉 {DE} {GB} NO12 {DE_BLANKS}", [DE, GB, DE_BLANKS]), (f"REF AB12 3456 {DE_BLANKS}.", [DE_BLANKS]), ("MT84MALT011000012345MTLCAST001S A", ["MT84MALT011000012345MTLCAST001S"]),
    (f"{DE}x {DE}1 x{DE}", []), (f"{DE} " * 2000, [DE] * 2000), ("AB12 " * 4000, []),
]


def test_ibans_end_where_they_end(documents):
    texts, wanted = zip(*IBANS)
    assert spans_of(documents, texts, "iban") == list(wanted)
    assert pii.redact(documents([(1, f"IBAN {DE} BIC X")])).first()["text"] == "IBAN [IBAN] BIC X"


def test_context_reaches_across_earlier_matches(documents):
    listing = "SSN: 123-45-6789, 234-56-7891, 345-67-8912"
    far = "ssn" + " " * 46 + "123-45-6789"  # 49 code points from the start of the word to the span
    texts = [listing, "é🎉 " + listing, far, far.replace("  ", " ", 1), "ssn 123-45-6789" + " 🎉" * 9 + " 234-56-7891", "number 123-45-6789, 234-56-7891", f"example {DE}, {GB}", f"example {DE}" + " ." * 24 + GB, "ssn AB12 " + "AB12 " * 7 + "123-45-6789"]
    listed = ["123-45-6789", "234-56-7891", "345-67-8912"]
    assert spans_of(documents, texts, "ssn") == [listed, listed, [], listed[:1], listed[:2], [], [], [], listed[:1]]
    assert spans_of(documents, texts, "iban")[6:8] == [[], [GB]]
    assert pii.redact(documents([(1, listing)])).first()["text"] == "SSN: [SSN], [SSN], [SSN]"


def test_long_secrets_are_taken_whole(documents):
    texts = ["token=" + "a1" * 200, "my api_key: " + "b2" * 50_000 + " ends"]
    assert spans_of(documents, texts, "secret") == [[texts[0]], [texts[1][3:-5]]]
    assert [r["text"] for r in pii.redact(documents(list(enumerate(texts)))).orderBy("doc_id").collect()] == ["[SECRET]", "my [SECRET] ends"]


def test_context_after_a_span_raises_only(documents):
    texts = ["123-45-6789 (SSN)", "123-45-6789 is my social security number", "123-45-6789" + " ." * 24 + " SSN", "ssn 123-45-6789 with order 5", "🎉" * 300 + "123-45-6789 ssn"]
    one = ["123-45-6789"]
    assert spans_of(documents, texts, "ssn") == [one, one, [], one, one]


def masked(text, spans):
    """Spans (start, end, kind) replaced, overlapping ones by the first kind."""
    out, at, open_until = [], 0, 0
    for start, end, kind in sorted(spans):
        if start >= open_until:
            out += [text[at:start], f"[{kind.upper()}]"]
        open_until = at = max(open_until, end)
    return "".join([*out, text[at:]])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a@b.co ", "1.2.3.4", "+4111 1111 1111 1111", " é🎉 ", "ssn 123-45-6789", DE, "x" * 300, ", ", "4111111111111111", "token=abcdefgh12345678"]), max_size=25).map("".join), min_size=30, max_size=30))
def test_redaction_against_spans(spark, documents, texts):
    docs = documents(list(enumerate(texts)))
    found = {r["doc_id"]: [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.report(docs).collect()}
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {i: masked(t, found[i]) for i, t in enumerate(texts)}


def seconds(documents, n):
    """To find and to mask ``n`` addresses, and as many numbers, in one text."""
    docs = documents([(1, " ".join(f"name{i}@host{i % 97}.example.org" for i in range(n))), (2, "; ".join(f"ssn {100 + i % 800}-{10 + i % 89}-{1000 + i % 8999}" for i in range(n)))]).persist()
    docs.count()
    begun = time.monotonic()
    assert pii.report(docs).agg(F.sum("n_email")).first()[0] == n
    assert pii.redact(docs).where("length(text) > 8 * doc_id").count() == 2
    docs.unpersist()
    return time.monotonic() - begun


def test_time_grows_with_the_matches(spark, documents):
    seconds(documents, 100)
    few, many = seconds(documents, 25_000), seconds(documents, 200_000)
    assert many < 16 * max(few, 1.0), (few, many)  # 8 times the matches; their square would take 64 times as long
