"""Bases, k-mers and their integer codes (A 0, C 1, G 2, T 3; first base most significant)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, DIGITS = "ACGT", "0123"
#: Longest k-mer whose code fits a bigint.
LONGEST = 31


def check_k(k: int) -> int:
    """``k`` if codes of that length fit a bigint."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k must be between 1 and {LONGEST}")
    return k


def encode(kmer: Column) -> Column:
    """Code of a valid k-mer; null if a character isn't one of ACGT, or the k-mer is empty or over 31 bases."""
    valid = kmer.rlike(f"^[ACGT]{{1,{LONGEST}}}$")
    return F.when(valid, F.conv(F.translate(kmer, BASES, DIGITS), 4, 10).cast("bigint"))


def decode(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), check_k(k), "0"), DIGITS, BASES)


def is_valid(kmer: Column, k: int) -> Column:
    """Whether a k-mer has ``k`` characters, all in ACGT."""
    return kmer.rlike(f"^[ACGT]{{{k}}}$")


def valid_windows(sequence: Column, k: int) -> Column:
    """Number of windows of ``k`` valid bases in a sequence."""
    return F.aggregate(F.split(sequence, "[^ACGT]+"), F.lit(0).cast("bigint"), lambda a, run: a + F.greatest(F.length(run) - (k - 1), F.lit(0)))


def from_text(text: Column) -> Column:
    """A stand-in sequence for free text: letters go to bases in turn, all else stays invalid."""
    return F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def effective_length(sequence: Column, read_length: int) -> Column:
    """Places where a read of that length can start."""
    return (F.length(sequence) - read_length + 1).cast("bigint")


def header_id(header: Column, sep: str = " ") -> Column:
    """First field of a header."""
    return F.split_part(header, F.lit(sep), F.lit(1))


def names_in(header: Column) -> Column:
    """All transcript names (letters, underscore, digits, dot, digits) of a header."""
    return F.regexp_extract_all(header, F.lit(r"(\w*_\d*\.\d*)"), 1)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from 52 bits of md5 over the key: the same on every run and in any engine."""
    text = F.concat_ws("-", F.lit(str(seed)), *(c.cast("string") for c in key))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / float(2**52)


def reads_per_transcript(width: Column) -> Column:
    """20-fold coverage by reads of 100 bases, halves to even."""
    return F.bround(width * 20 / 100.0)
