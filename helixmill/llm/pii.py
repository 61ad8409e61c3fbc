"""Operator 6, personal data by DataFrame functions alone.

Regular expressions propose spans; checksums (Luhn for cards, mod-97 for IBANs) and range checks confirm them; words
near a span adjust its score. The four base kinds (email, ip, card, phone) stand on pattern and check alone.
Further kinds (iban, ssn, secret) need a score of ``THRESHOLD`` or more: words before a span raise or lower it, words
after it raise it.

The patterns give the matches of the plain ones that the comments show, and are written so that Java's matcher does
linear work on any text and doesn't recurse: possessive loops, and look-behinds that forbid starts inside a run that
has failed before.

A text is cut at its matches once for each kind. Places are running sums over the cut pieces, by doubling: n pieces
take log2(n) passes over the array, and no array grows inside a fold. Stretches of the text (contexts, what stands
between spans) come from blocks of ``BLOCK`` code points, so none is looked for from the beginning of the text.

Texts are taken whole. Defined results: a null or empty text has no spans; repeated rows give repeated results; an
empty table gives an empty result; columns of other names are carried by ``redact`` and ignored by ``report``, and none
of their names gets in the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order in which spans are listed, then the kinds that the score decides.
BASE = ("email", "ip", "card", "phone")
SCORED = ("iban", "ssn", "secret")
KINDS = (*BASE, *SCORED)
THRESHOLD = 0.6
#: How far from a span context words count, in code points.
CONTEXT = 48
#: Code points of a block of text.
BLOCK = 256

PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits; other lengths can't pass
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # only the first four characters are taken, so that a run may hold the start of another; what follows is looked at
    "iban": r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2})(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key)[\x20]?[=:][\x20]?\"?[a-z0-9_/+-]{16,}+\"?",
}
#: What a match becomes between cuts, and how many pieces it and the text before it make. An IBAN's second piece is a copy.
WRITTEN, STEP = {"iban": ("$1", "$2")}, {"iban": 3}
#: Characters of an IBAN without blanks by country; in countries that aren't listed any of 15 to 34 is tried.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: Score of a confirmed pattern, words that raise it when they stand near, and words that lower it when they stand before.
PRIOR = {"iban": 0.8, "ssn": 0.5, "secret": 0.7}
RAISES = {"iban": r"(?i)\b(iban|account|konto|compte|cuenta|bank)", "ssn": r"(?i)\b(ssn|social security|tax id|taxpayer)", "secret": r"(?i)\b(auth|bearer|key|login|credential)"}
LOWERS = {"iban": r"(?i)\b(example|serial|part no)", "ssn": r"(?i)\b(order|ticket|isbn|part no|serial)", "secret": r"(?i)\b(example|placeholder|dummy)"}
#: A noncharacter marks the cuts; where a text holds it, another of the same length stands in, which no pattern takes.
CUT, STAND_IN = "￿", "￾"
SPANS = "array<struct<start:int,end:int,match:string>>"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""

    def weighed(c: Column, i: Column) -> Column:
        n = F.ascii(c) - 48
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes mod-97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def iban(run: Column) -> Column:
    """The IBAN that a run of words starts with, null if none passes mod-97.

    It ends at the end of a word. The length of its country goes first, then the whole run; in a country that isn't
    listed every end of a word counts, the last first.
    """
    of_country = F.element_at(F.create_map(*(F.lit(x) for c in IBAN_LENGTHS.items() for x in c)), F.left(run, F.lit(2)))

    def bare(end: Column) -> Column:
        return F.replace(F.left(run, end), F.lit(" "), F.lit(""))

    def passes(end: Column) -> Column:
        size = F.length(bare(end))
        meant = of_country.isNull() | (size == of_country) | (end == F.length(run))
        return F.substr(run, end + 1, F.lit(1)).isin("", " ") & size.between(15, 34) & meant & ~bare(end).rlike("[a-z]") & mod97(bare(end))

    ends = F.filter(F.sequence(F.length(run), F.lit(15), F.lit(-1)), passes)
    first = F.coalesce(F.get(F.filter(ends, lambda end: F.length(bare(end)) == of_country), F.lit(0)), F.get(ends, F.lit(0)))
    return F.left(run, first)


def confirmed(kind: str, match: Column) -> Column:
    """The check of a kind on a matched string."""
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return luhn(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return match.isNotNull()
    if kind == "secret":
        return match.rlike(r"[=:].*[0-9]") & match.rlike(r"(?i)[=:].*[a-z]")
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    """The score of a confirmed span by the words around it."""
    raised, lowered = before.rlike(RAISES[kind]) | after.rlike(RAISES[kind]), before.rlike(LOWERS[kind])
    return F.lit(PRIOR[kind]) + F.when(raised, 0.2).otherwise(0.0) - F.when(lowered, 0.3).otherwise(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each value with all before it; associative, and a null (there is none before) leaves the other."""

    def doubled(v: Column) -> Column:
        reaches = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda p: p < F.size(v))
        return F.aggregate(reaches, v, lambda held, p: F.transform(held, lambda x, i: join(x, F.get(held, i - p))))

    return let(values, doubled)


def blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def stretch(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text in blocks; end may lie beyond the text."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    held = F.when(first == last, F.get(cut, first)).otherwise(F.array_join(F.transform(F.sequence(first, last), lambda b: F.get(cut, b)), ""))
    return F.when(end > start, F.substr(held, start - first * BLOCK + 1, end - start)).otherwise("")


def spans_of(kind: str, text: Column) -> Column:
    """(start, end, match) of a kind in a text that isn't null, ascending; end is exclusive."""
    step = STEP.get(kind, 2)
    marked = CUT + "".join(w + CUT for w in WRITTEN.get(kind, ("$0",)))

    def found(cut: Column) -> Column:
        lengths = F.transform(cut, lambda p, i: F.when(i % step == 2, 0).otherwise(F.length(p)))

        def placed(ends: Column) -> Column:
            def span(i: Column) -> Column:
                match = iban(F.concat(F.get(cut, i), F.get(cut, i + 1))) if kind == "iban" else F.get(cut, i)
                return F.struct(F.get(ends, i - 1).alias("start"), match.alias("match"))

            every = F.transform(F.sequence(F.lit(1), F.size(cut) - step, F.lit(step)), span)
            passed = F.filter(every, lambda s: confirmed(kind, s["match"]))
            return F.transform(passed, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match")))

        return let(running(lengths, lambda x, before: x + F.coalesce(before, F.lit(0))), placed)

    def scored(spans: Column) -> Column:
        def near(cut: Column) -> Column:
            return F.filter(spans, lambda s: score(kind, stretch(cut, F.greatest(F.lit(0), s["start"] - CONTEXT), s["start"]), stretch(cut, s["end"], s["end"] + CONTEXT)) >= THRESHOLD)

        return F.when(F.size(spans) > 0, let(blocks(text), near)).otherwise(spans)

    spans = let(F.split(F.regexp_replace(text, F.lit(PATTERNS[kind]), F.lit(marked)), CUT, -1), found)
    return F.when(text.rlike(PATTERNS[kind]), let(spans, scored) if kind in SCORED else spans).otherwise(F.array().cast(SPANS))


def find(text: Column) -> Column:
    """A struct with an array of (start, end, match) for each kind."""
    whole = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(CUT), F.lit(STAND_IN))
    return let(whole, lambda t: F.struct(*(spans_of(kind, t).alias(kind) for kind in KINDS)))


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of found spans, comma-joined."""

    def written(kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(written, kinds)), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), find(F.col(f"`{text_col}`")).alias("found"))
    found = F.col("found")
    return rows.select("doc_id", *(F.size(found[k]).cast("bigint").alias(f"n_{k}") for k in BASE), F.sha2(listed(found, BASE), 256).alias("base_sha256"), listed(found, KINDS).alias("spans"))


def masked(text: Column) -> Column:
    """A text with every found span replaced by its kind in brackets; overlapping spans become one, of the first kind.

    A text without spans stays as it is, and so does a null one.
    """

    def named(found: Column, kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def replaced(every: Column) -> Column:
        def cut_at(reach: Column) -> Column:
            # A span that starts before the end of an earlier one is part of it.
            opens = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: F.get(every, i)["start"] >= F.coalesce(F.get(reach, i - 1), F.lit(0)))

            def written(first: Column) -> Column:
                def piece(cut: Column, i: Column) -> Column:
                    s = F.get(every, i)
                    return F.concat(stretch(cut, F.coalesce(F.get(reach, i - 1), F.lit(0)), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))

                def whole(cut: Column) -> Column:
                    tail = stretch(cut, F.element_at(reach, -1), F.size(cut) * BLOCK)
                    return F.concat(F.array_join(F.transform(first, lambda i: piece(cut, i)), ""), tail)

                return let(blocks(text), whole)

            return let(opens, written)

        ends = F.transform(every, lambda s: s["end"])
        return F.when(F.size(every) > 0, let(running(ends, F.greatest), cut_at)).otherwise(text)

    every = let(find(text), lambda found: F.array_sort(F.concat(*(named(found, kind) for kind in KINDS))))
    return F.when(text.isNotNull(), let(every, replaced))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of its texts masked, all other columns as they are."""
    return docs.withColumn(text_col, masked(F.col(f"`{text_col}`").cast("string")))
