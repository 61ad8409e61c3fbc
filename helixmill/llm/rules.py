"""Operator 7, quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics of a whole text are counted over its bytes with numpy. Two plain rules fail a document outright (too few
words, or most words inside repeated three-word windows). The others are judged by trees that are trained here on a
bounded sample of labelled rows, flattened into node arrays and scored for a batch at once. The constraints say that
more repetition, more repeated lines, more symbols and more capitals never make a document better.

The sample is the ``TRAIN_ROWS`` labelled documents of lowest id hash; fewer than ``LEAST_ROWS`` of either label train
nothing, and the verdict is then the plain rules'. A document is rejected if the trees give it ``REJECT`` or more.

Texts are taken whole. Defined results: a null or empty text has no words and fails; repeated rows give repeated
results, and rows that share a doc_id teach as one; an empty table gives an empty result; other columns of the input,
whatever their names, are carried by ``keep`` and ignored by ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm import trees
from helixmill.llm.common import as_bytes, by_id, steps

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
#: Labelled rows that training takes at most.
TRAIN_ROWS = 6000
LEAST_ROWS = 10
REJECT = 0.8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and their constraints: 1 if a larger value may only make a document worse.
FEATURES = {"symbols": 1, "capitals": 1, "repeats": 1, "dup_lines": 1, "marks": 1, "digits": 0, "distinct": 0, "word_length": 0, "log_words": 0, "line_words": 0}


def statistics(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of ``COUNTS`` and the features of ``FEATURES`` of a text in UTF-8."""
    words = data.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    blanks = by_byte[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]].sum()
    chars = int(len(data) - by_byte[0x80:0xC0].sum() - blanks)
    symbols = int(by_byte[list(SYMBOLS)].sum())
    lines, seen, dup_lines, full_lines = data.split(b"\n"), set(), 0, 0
    for line in lines:
        if line.strip():
            full_lines += 1
            dup_lines += line in seen
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeats = 0
    if n >= 3:
        size = len(number)
        pairs = ids[:-1] * size + ids[1:]
        if size < 2_000_000:
            windows = pairs[:-1] * size + ids[2:]
        else:  # three numbers would not fit one int64
            windows = np.unique(pairs, return_inverse=True)[1][:-1] * size + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= twice
        repeats = int(covered.sum())
    some = max(chars, 1)
    features = (
        symbols / some,
        by_byte[0x41:0x5B].sum() / some,
        repeats / max(n, 1),
        dup_lines / max(full_lines, 1),
        by_byte[[0x21, 0x3F]].sum() / some,
        by_byte[0x30:0x3A].sum() / some,
        len(number) / max(n, 1),
        chars / max(n, 1),
        float(np.log1p(n)),
        n / max(full_lines, 1),
    )
    return (n, chars, symbols, dup_lines, repeats), tuple(map(float, features))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and badness (label 0) of a bounded sample of labelled documents, by the hash of their ids."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            values = [list(statistics(x)[1]) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # The chosen ids are ``rows`` at most, so their side is small by construction; so is what is collected, a row for each.
    taken = by_id(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    each = taken.mapInArrow(run, "doc_id bigint, quality int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row"))
    found = [r["row"] for r in sorted(each.collect(), key=lambda r: r["doc_id"])]
    return np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([1 - r["quality"] for r in found], float)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> trees.Forest | None:
    """The trees, or None if either label has fewer than ``LEAST_ROWS`` rows."""
    x, y = training_rows(docs, labels, rows)
    if min((y == 1).sum(), (y == 0).sum()) < LEAST_ROWS:
        return None
    return trees.fit(x, y, np.array(list(FEATURES.values())))


def judged(data: list[bytes], forest: trees.Forest | None, reject: float) -> dict[str, list]:
    """Counts and verdicts of a list of texts."""
    found = [statistics(x) for x in data]
    out: dict[str, list] = {c: [f[0][i] for f in found] for i, c in enumerate(COUNTS)}
    out["base_failed"] = [f[0][0] < LEAST_WORDS or 100 * f[0][4] > 50 * f[0][0] for f in found]
    bad = forest.probability(np.array([f[1] for f in found])) if forest and found else np.zeros(len(found))
    out["badness"] = [float(x) for x in bad]
    out["kept"] = [not failed and x < reject for failed, x in zip(out["base_failed"], bad, strict=True)]
    return out


def report(docs: DataFrame, forest: trees.Forest | None, reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, badness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = judged(as_bytes(batch.column("text")), forest, reject)
            columns = [batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in COUNTS), pa.array(out["base_failed"], pa.bool_()), pa.array(out["kept"], pa.bool_()), pa.array(out["badness"], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "badness"])

    return by_id(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, badness double")


def keep(docs: DataFrame, forest: trees.Forest | None, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps((b.rename_columns([f"c{i}" for i in range(len(names))]) for b in batches), f"c{at}"):
            mask = judged(as_bytes(batch.column(at)), forest, reject)["kept"]
            yield batch.filter(pa.array(mask, pa.bool_())).rename_columns(names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
