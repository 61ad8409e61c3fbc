import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their results or inside.
CLASHES = ("n_tokens", "ids", "decoded", "size", "key", "taken", "target", "score", "kept", "range", "place", "order", "doc", "part", "name", "fingerprint", "n_shingles", "bands", "spans", "set", "cell", "found", "text_col", "__text", "__email", "__key", "__h", "__copies", "__copy", "h", "copies", "order_key", "next_text", "edited", "n_near", "id", "n", "label", "token")


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text) or (doc_id, text, source) rows to a documents table with extra columns."""
    from pyspark.sql import functions as F

    def make(rows, clashes=True, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, COLUMNS).repartition(partitions)
        return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df

    return make


WORDS = "of the heron anst tion with ering shore blea ingth ouner thand".split()
LONG = " ".join(f"{WORDS[i % 12]}{i % 97}" for i in range(40_000))
#: Nulls, empty and blank texts, repeated rows, ties, a null id, a null source, accents and a very long text.
EDGES = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \t\n\x0b\f\r ", "b"),
    (4, "one two", "b"),
    (5, "the same words stand here twice over and over", None),
    (5, "the same words stand here twice over and over", None),
    (6, "The SAME words stand here twice over and over", "c"),
    (None, "no id here at all but words", "c"),
    (7, "Ünïcode — “quotes” 日本語 🎉 naïve space line", "c"),
    (8, LONG, "d"),
    (9, LONG, "d"),
    (11, "one text of a document that has two of them"),
    (12, "one text of a document that has two of them"),
    (12, "other words make up the second text of number twelve"),
    (12, ""),
    (13, "other words make up the second text of number twelve"),
    (10, "<|endoftext|> mail me at a.b@c.de or +49 (30) 1234-5678, card 4111 1111 1111 1111, ip 10.0.0.1.", "d"),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES
