"""A corpus pipeline of five stages, each by an operator of ``helixmill.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of ``documents``. ``run`` applies them to the documents of a data folder, each written as Parquet in the shared
folder and read again; a stage's table goes when the next one is written.

All stages take null, empty and very long texts, repeated rows, empty tables and extra columns of any names, which are
dropped; what each makes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import bpe, minhash, mixing, pii, rules
from helixmill.llm.common import Scratch, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The trees learn from the labelled rows among ``docs``.

    Null, empty and short texts go; repeated rows stay or go together; without enough labels the plain rules decide.
    """
    return rules.keep(docs.select(*COLUMNS), rules.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id.

    Documents without words and rows without a doc_id stay; rows that share a doc_id are one document and stay together.
    """
    return minhash.deduplicated(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text.

    All rows stay; a null text stays null, with null n_chars, and a text without personal data stays as it is.
    """
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document stands as often as the mix takes it, which may be never.

    Null sources are one source; rows that share a doc_id are taken together; texts without words weigh nothing.
    """
    return mixing.mix(docs.select(*COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_crc32; a null text is empty."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: Trees, MinHash links and merges can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for at, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        last = at == len(STAGES) - 2
        after = written(out) if last else scratch.write(out)
        scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
