"""FASTA and FASTQ as DataFrames, and their writers.

FASTA records come from Spark's text reader, one row for each record (``lineSep`` is a line end and ``>``), so large
files are split and read in parallel, and no record is shuffled. A header is the first line of a record without ``>``;
sequence lines are stripped and joined. What stands before the first ``>`` is no record. Paths go through Spark, so any
store that Spark reads will do; FASTQ comes from the data source of ``helixmill.sources.fastq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.sources.fastq import SPLIT, FastqSource, ranges_of

BLANKS = " \t\n\x0b\f\r"
#: Files up to which their first records go to all tasks; beyond, they are joined by shuffle.
FEW_FILES = 200_000


def _files(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _raw_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block (start of the split, row), value, and first: whether it is the first record of its file.

    Only that one can still have its '>'. It is the least row of the split at 0, a row for each file.
    """
    raw = spark.read.option("lineSep", "\n>").text(_files(paths))
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    heads = raw.where("start = 0").groupBy("file").agg(F.min("row").alias("head"))
    heads = F.broadcast(heads) if len(raw.inputFiles()) <= FEW_FILES else heads
    return raw.join(heads, "file", "left").select("file", F.struct("start", "row").alias("block"), "value", F.coalesce(F.col("row") == F.col("head"), F.lit(False)).alias("first"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block, header, sequence. ``block`` orders the records of a file by their place in it."""
    text = F.when(F.col("first") & F.col("value").startswith(">"), F.expr("substr(value, 2)")).when(~F.col("first"), F.col("value"))
    lines = _raw_records(spark, paths).withColumn("__text", text).where(F.col("__text").isNotNull())
    end = F.instr("__text", "\n")
    header = F.rtrim(F.when(end > 0, F.expr("substr(__text, 1, instr(__text, '\n') - 1)")).otherwise(F.col("__text")), F.lit(BLANKS))
    body = F.when(end > 0, F.expr("substr(__text, instr(__text, '\n') + 1)")).otherwise("")
    # Blanks at both ends of each line go; blanks inside a line stay.
    sequence = F.regexp_replace(F.btrim(body, F.lit(BLANKS)), r"[ \t\x0b\f\r]*\n[ \t\n\x0b\f\r]*", "")
    parsed = lines.select("file", "block", "first", header.alias("header"), sequence.alias("sequence"))
    return parsed.where(~(F.col("first") & (F.col("header") == "") & (F.col("sequence") == ""))).drop("first")


def read_fasta_native(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Like ``read_fasta`` but a file's first line is a header whatever it begins with, and headers keep '>'."""
    text = _raw_records(spark, paths).withColumn("__t", F.when(F.col("first"), F.col("value")).otherwise(F.concat(F.lit(">"), "value")))
    end = F.instr("__t", "\n")
    header = F.when(end > 0, F.expr("substr(__t, 1, instr(__t, '\n') - 1)")).otherwise(F.col("__t"))
    body = F.when(end > 0, F.expr("substr(__t, instr(__t, '\n') + 1)")).otherwise("")
    return text.select("file", "block", header.alias("header"), F.regexp_replace(body, r"[ ]*\n|[ ]+$", "").alias("sequence")).where("header != ''")


def read_fastq(spark: SparkSession, paths: str | list[str], split: int = SPLIT) -> DataFrame:
    """file, seq_idx, header, sequence of FASTQ files or folders of them, gzipped or not.

    Plain files over ``split`` bytes are read in ranges of that size. Records of a range are numbered in it; a count of each
    range, a row each, moves them to their place in the file. Raises on a file whose lines aren't a multiple of four.
    """
    spark.dataSource.register(FastqSource)
    found = spark.read.format(FastqSource.name()).option("paths", "\n".join(_files(paths))).option("splitBytes", str(split)).load()
    ranges = ranges_of(_files(paths), split)
    if all(r.start == 0 for r in ranges):
        return found.drop("range")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("file", "range").agg(F.count("*").alias("__n"))
    moved = sizes.select("file", "range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    moved = F.broadcast(moved) if len(ranges) <= FEW_FILES else moved
    return found.join(moved, ["file", "range"]).select("file", (F.col("seq_idx") + F.col("__at")).alias("seq_idx"), "header", "sequence")


def read_quant(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated quantification table with a header line, gzipped or not."""
    return spark.read.csv(path, sep="\t", header=True)


def read_list(spark: SparkSession, path: str, suffix: str = ".fa") -> DataFrame:
    """A list of ids, one a line, without their suffix."""
    ids = F.trim("value", F.lit(BLANKS))
    bare = F.when(F.col("__v").endswith(suffix), F.expr(f"left(__v, length(__v) - {len(suffix)})")).otherwise(F.col("__v"))
    return spark.read.text(path).select(ids.alias("__v")).select(bare.alias("id")).where("id != ''")


def folded(sequence: Column, width: int) -> Column:
    """A sequence in lines of ``width`` bases."""
    last = F.floor((F.greatest(F.length(sequence), F.lit(1)) - 1) / width).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(sequence, i * width + 1, F.lit(width))), "\n")


def write_fasta(records: DataFrame, path: str, header: str = "header", sequence: str = "sequence", width: int | None = None, mode: str = "error") -> None:
    """FASTA files of a folder, one for each partition."""
    body = folded(F.col(sequence), width) if width else F.col(sequence)
    records.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value")).write.mode(mode).text(path)


def write_fasta_by(records: DataFrame, path: str, key: str, header: str = "header", sequence: str = "sequence", mode: str = "error") -> None:
    """A folder for each value of ``key``."""
    records.select(key, F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value")).write.mode(mode).partitionBy(key).text(path)


def write_fastq(records: DataFrame, path: str, header: str = "header", sequence: str = "sequence", mode: str = "error") -> None:
    """Gzipped FASTQ files of a folder, with the best quality for each base."""
    lines = F.concat_ws("\n", F.concat(F.lit("@"), F.col(header)), F.col(sequence), F.lit("+"), F.regexp_replace(sequence, "(?s).", "I"))
    records.select(lines.alias("value")).write.mode(mode).option("compression", "gzip").text(path)
