"""Operator 5, quality by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad documents. A text is
compressed in blocks under each; a text like the good ones comes out smaller under the good dictionary. The difference
of the compressed sizes, normalised by the text's length, becomes a score by logistic calibration on labelled rows that
built no dictionary. Blocks are short, so that a text is judged by the dictionaries and not by its own beginning, and
one that repeats itself doesn't shrink alike under both; all blocks of a text count.

Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not ``HELD_OUT``, from a bounded sample: the
``TRAIN_ROWS`` of each label with the lowest id hash, as far as ``TRAIN_BYTES`` of each label go; texts over
``LONGEST`` bytes teach nothing. The bytes are summed before any text reaches the driver. Labels, language, source and
doc_id are no inputs of a score.

Texts are scored whole. Defined results: an empty or null text gets the score that calibration gives difference 0;
without ``LEAST_ROWS`` rows of each label every score is 0.5; repeated rows give repeated results, and rows that share
a doc_id teach by the shortest of their texts; an empty table gives an empty result; a null doc_id counts as the text
"null" for the held-out fold; columns of other names are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import as_bytes, by_id, steps

FOLDS, HELD_OUT = 4, 2
#: Labelled rows of each label that training takes at most, and bytes of text of each label that reach the driver.
TRAIN_ROWS, TRAIN_BYTES, LONGEST = 1500, 12_000_000, 1_000_000
LEAST_ROWS = 10
DICTIONARY_BYTES = 96 * 1024
#: Bytes of a block that dictionaries learn from, and of one that is scored.
LEARNT_BLOCK, BLOCK = 2048, 256
LEVEL = 3
ACCEPT = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibration; small enough to travel with each task."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod ``FOLDS``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS


@functools.lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple:
    out = []
    for content in (good, bad):
        own = zstandard.ZstdCompressionDict(content)
        own.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(out)


def difference(data: bytes, good: bytes, bad: bytes) -> float:
    """(bad size - good size) / length over all blocks of a text."""
    if not data:
        return 0.0
    by_good, by_bad = (c.compress for c in _compressors(good, bad))
    total = 0
    for start in range(0, len(data), BLOCK):
        block = data[start : start + BLOCK]
        total += len(by_bad(block)) - len(by_good(block))
    return total / len(data)


def inputs(differences: np.ndarray) -> np.ndarray:
    """Inputs of the calibration: 1 and the difference."""
    return np.stack([np.ones(len(differences)), 10 * differences], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, both labels weighing alike."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary from all blocks of the texts; with too few to train one, the texts themselves."""
    blocks = [t[i : i + LEARNT_BLOCK] for t in texts for i in range(0, len(t), LEARNT_BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[int, bytes]]:
    """(quality, text) of the bounded sample, in the order of the id hash."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id")) != HELD_OUT)
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("__h", F.xxhash64("doc_id"))
    chosen = None
    for quality in (0, 1):
        part = usable.where(F.col("quality") == quality).orderBy("__h", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * rows ids at most, so this side is small by construction.
    own = by_id(docs, "doc_id", "text").where("text != ''").join(F.broadcast(chosen), "doc_id")
    own = own.withColumn("pick", F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))).where(F.col("pick.size") <= LONGEST)
    picked = own.groupBy("doc_id", "quality", "__h").agg(F.min("pick").alias("pick"))
    upto = Window.partitionBy("quality").orderBy("__h", "doc_id")
    picked = picked.withColumn("upto", F.sum("pick.size").over(upto)).where(F.col("upto") <= TRAIN_BYTES).select("doc_id", "pick")
    taken = own.join(F.broadcast(picked), ["doc_id", "pick"]).groupBy("doc_id", "quality", "__h").agg(F.min("text").alias("text"))
    return [(int(r["quality"]), r["text"].encode("utf-8", "replace")) for r in sorted(taken.collect(), key=lambda r: (r["__h"], r["doc_id"]))]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Half of the sample builds the dictionaries, the other half calibrates."""
    sample = training_texts(docs, labels, rows)
    by_label = [[t for q, t in sample if q == quality] for quality in (0, 1)]
    if min(map(len, by_label)) < LEAST_ROWS:
        return None
    bad, good = (dictionary(texts[::2]) for texts in by_label)
    rest = [(q, t) for q in (0, 1) for t in by_label[q][1::2]]
    x = inputs(np.array([difference(t, good, bad) for _, t in rest]))
    return Model(good, bad, tuple(logistic(x, np.array([q for q, _ in rest], float))))


def score(docs: DataFrame, model: Model | None, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                found = np.array([difference(x, model.good, model.bad) for x in as_bytes(batch.column("text"))])
                scores = 1 / (1 + np.exp(-np.clip(inputs(found) @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = by_id(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
