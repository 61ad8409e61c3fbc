"""Where queries are registered, and the tables and SQL that they share.

The tables hold no DNA, so texts stand in: letters go to bases in turn and all else stays invalid. Documents are
isoforms, their sources are files, and turns of conversations are reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.bases import from_text
from helixmill.operators import counts, matrix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SEQ = "translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def code(k: int, kmer: str = "kmer") -> str:
    """SQL for the code of a k-mer."""
    return "(" + " + ".join(f"(strpos('ACGT', substr({kmer}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k)) + ")::BIGINT"


def valid_words(name: str, k: int, source: str, keys: str = "") -> str:
    """SQL of a CTE of all valid k-mers of ``source`` (with a column s): keys, i, kmer."""
    own = f"{keys}, " if keys else ""
    return f"{name} AS (SELECT {own}i, substr(s, i, {k}) AS kmer FROM (SELECT {own}s, unnest(range(1, length(s) - {k} + 2)) AS i FROM {source}) WHERE regexp_full_match(substr(s, i, {k}), '[ACGT]{{{k}}}'))"


DOCS = f"seqs AS (SELECT doc_id AS isoform_id, source, {SEQ} AS s FROM documents)"
READS = f"reads AS (SELECT {SEQ} AS s FROM conversations)"


def x_cte(k: int, source: str = "seqs") -> str:
    """SQL of X over ``source``."""
    return f"{valid_words('xk', k, source, 'isoform_id')}, x AS (SELECT {code(k)} AS kmer_id, isoform_id, count(*) AS cnt, count(*) / sum(count(*)) OVER (PARTITION BY isoform_id) AS p FROM xk GROUP BY isoform_id, kmer)"


def y_cte(k: int) -> str:
    """SQL of counts over conversations."""
    return f"{valid_words('yk', k, 'reads')}, y AS (SELECT {code(k)} AS kmer_id, count(*) AS y FROM yk GROUP BY kmer)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as isoforms."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("isoform_id"), "source", from_text(F.coalesce("text", F.lit(""))).alias("sequence"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as reads."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", from_text(F.coalesce("text", F.lit(""))).alias("sequence"))


def x_and_y(spark: SparkSession, sf_dir: str, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """X of the documents and y of the conversations."""
    return matrix.build_matrix(isoforms(spark, sf_dir), k), counts.kmer_counts(reads(spark, sf_dir), k)


XY = f"{DOCS}, {READS}, {x_cte(3)}, {y_cte(3)}, t AS (SELECT count(*) AS n FROM documents), o AS (SELECT x.*, y.y FROM x JOIN y USING (kmer_id)), w AS (SELECT sum(y) AS total FROM (SELECT DISTINCT kmer_id, y FROM o))"
