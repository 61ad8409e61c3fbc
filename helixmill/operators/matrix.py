"""The sparse k-mer by isoform matrix X as a table: kmer_id, isoform_id, cnt, p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.bases import valid_windows
from helixmill.operators.order import running
from helixmill.operators.shred import code_of, row_counts, shred, shred_positions, spanning_blocks, spread
from helixmill.session import written

#: Partitions of X for each partition of the sequences.
PARTS = 4


def keep_records(records: DataFrame, min_length: int = 0, header: str | None = "header", sequence: str = "sequence", reject: str = "PREDICTED") -> DataFrame:
    """Drops records whose header contains ``reject`` and those shorter than ``min_length``."""
    kept = records.where(F.length(sequence) >= min_length) if min_length else records
    return kept.where(~F.contains(F.col(header), F.lit(reject))) if header else kept


def dense_ids(records: DataFrame, *order: str, name: str = "isoform_id") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the columns, which should tell all rows apart."""
    return running(records.withColumn("__one", F.lit(1).cast("bigint")), list(order), "__one", name).drop("__one")


def build_matrix(isoforms: DataFrame, k: int, id_col: str = "isoform_id", sequence: str = "sequence") -> DataFrame:
    """Counts of each isoform's k-mers and their share among its valid ones; columns of X sum to 1.

    K-mers are counted row by row, and only an isoform's counts are shuffled, once, to where its sum is known too. Rows
    that share an id are one isoform. An isoform without valid k-mers has no rows.
    """
    one = isoforms.select(F.col(id_col).alias("isoform_id"), F.col(sequence).alias("sequence"))
    # As many partitions as the input asks for, whatever the session's number, so that none grows with it.
    parts = PARTS * max(one.rdd.getNumPartitions(), one.sparkSession.sparkContext.defaultParallelism)
    counted = row_counts(spread(one), k, "sequence", "isoform_id").repartition(parts, "isoform_id").groupBy("isoform_id", "kmer_id").agg(F.sum("cnt").alias("cnt"))
    whole = F.sum("cnt").over(Window.partitionBy("isoform_id"))
    return counted.select("kmer_id", "isoform_id", "cnt", (F.col("cnt") / whole).alias("p"))


def file_matrix(records: DataFrame, k: int, file: str, order: str, min_length: int = 0, sequence: str = "sequence") -> DataFrame:
    """X with an isoform for each file, its records joined in order: kmer_id, isoform_id (the file), cnt, p.

    A file whose joined text is shorter than ``min_length`` has no rows; ``short_files`` names these empty columns.
    """
    blocks = written(spanning_blocks(records, k, file, order, sequence))
    kept = blocks.join(short_files(records, file, min_length, sequence), file, "left_anti") if min_length else blocks
    whole = kept.groupBy(file).agg(F.sum(valid_windows(F.col(sequence), k)).alias("total")).where("total > 0")
    counted = shred(kept, k, sequence, (file,)).groupBy(file, "kmer").agg(F.count("*").alias("cnt")).join(whole, file)
    return counted.select(code_of(F.col("kmer")).alias("kmer_id"), F.col(file).alias("isoform_id"), "cnt", (F.col("cnt") / F.col("total")).alias("p"))


def short_files(records: DataFrame, file: str, min_length: int, sequence: str = "sequence") -> DataFrame:
    """Files whose records together are shorter than ``min_length``."""
    return records.groupBy(file).agg(F.coalesce(F.sum(F.length(sequence)), F.lit(0)).alias("__n")).where(F.col("__n") < min_length).select(file)


def read_aware_matrix(isoforms: DataFrame, k: int, read_length: int, id_col: str = "isoform_id", sequence: str = "sequence") -> DataFrame:
    """X weighted by how many reads of ``read_length`` cover each k-mer: kmer_id, isoform_id, weight, p.

    The reads that cover a place are counted from it and the length, without making them.
    """
    kept = isoforms.where(F.length(sequence) >= read_length)
    last = F.least(F.col("position"), F.col("length") - read_length)
    covering = last - F.greatest(F.lit(0), F.col("position") - (read_length - k)) + 1
    return weighted_matrix(kept, k, covering, id_col, sequence)


def weighted_matrix(isoforms: DataFrame, k: int, weight: Column, id_col: str = "isoform_id", sequence: str = "sequence") -> DataFrame:
    """X with a weight for each occurrence, an expression of ``position`` and ``length``: kmer_id, isoform_id, weight, p."""
    named = isoforms.select(F.col(id_col).alias("isoform_id"), F.col(sequence).alias("sequence"), F.length(sequence).alias("length"))
    placed = shred_positions(spread(named), k, "sequence", ("isoform_id", "length"))
    summed = placed.withColumn("__w", weight).groupBy("isoform_id", "kmer_id").agg(F.sum("__w").alias("weight"))
    whole = summed.groupBy("isoform_id").agg(F.sum("weight").alias("__t"))
    return summed.join(whole, "isoform_id").select("kmer_id", "isoform_id", "weight", (F.col("weight") / F.col("__t")).alias("p"))


def row_sums(x: DataFrame) -> DataFrame:
    """kmer_id, total."""
    return x.groupBy("kmer_id").agg(F.sum("p").alias("total"))


def covered(y: DataFrame, x: DataFrame) -> DataFrame:
    """Counts whose k-mer has a row in X."""
    return y.join(x.select("kmer_id").distinct(), "kmer_id", "left_semi")


def uncovered(y: DataFrame, x: DataFrame) -> DataFrame:
    """Counts whose k-mer has no row in X."""
    return y.join(x.select("kmer_id").distinct(), "kmer_id", "left_anti")


def clustered(x: DataFrame) -> DataFrame:
    """X in ranges of kmer_id, each ordered by (kmer_id, isoform_id)."""
    return x.repartitionByRange("kmer_id").sortWithinPartitions("kmer_id", "isoform_id")


def row_pointers(x: DataFrame, row: str = "kmer_id") -> DataFrame:
    """For each non-empty row: its number of entries and the place of its first one in row order."""
    sizes = x.groupBy(row).agg(F.count("*").alias("entries"))
    return running(sizes, [row], "entries", "start").select(row, "entries", F.col("start").cast("bigint").alias("start"))


def shape_faults(x: DataFrame, y: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """One row: rows of X and of y outside the 4^k k-mers, and isoforms of X without a length; all 0 if shapes agree."""
    outside = F.count_if((F.col("kmer_id") < 0) | (F.col("kmer_id") >= 4**k))
    unknown = x.select("isoform_id").distinct().join(lengths.select("isoform_id"), "isoform_id", "left_anti").agg(F.count("*").alias("isoforms_without_length"))
    return x.agg(outside.alias("x_outside")).withColumns({"y_outside": y.agg(outside).scalar(), "isoforms_without_length": unknown.scalar()})


def check_shapes(x: DataFrame, y: DataFrame, lengths: DataFrame, k: int) -> None:
    """Raises if shapes don't agree."""
    found = shape_faults(x, y, lengths, k).first().asDict()
    if any(found.values()):
        raise ValueError(f"matrix, counts and lengths don't agree: {found}")


def check_lengths(x: DataFrame, lengths: DataFrame) -> None:
    """Raises if an isoform of X has no length."""
    if not x.select("isoform_id").distinct().join(lengths, "isoform_id", "left_anti").isEmpty():
        raise ValueError("an isoform of the matrix has no length")
