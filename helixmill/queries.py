"""Queries over the tables of a data folder, and the SQL that says the same. Those of models and files are in modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill import file_queries, model_queries, table_queries
from helixmill.functions.bases import decode, effective_length, encode, from_text, header_id, names_in, uniform
from helixmill.operators import counts, lengths, linalg, matrix, metrics, minimisers, prep, sampling
from helixmill.operators.shred import code_of, shred, shred_pairs, shred_positions, spread
from helixmill.plans.simulate import every_kmer, sampled_reads
from helixmill.registry import DOCS, ORACLE_SQL, QUERIES, READS, SEQ, XY, code, isoforms, query, read, reads, valid_words, x_and_y, x_cte, y_cte
from helixmill.session import result_path
from helixmill.streaming.counts import counts_available_now

__all__ = ["ORACLE_SQL", "QUERIES", "file_queries", "model_queries", "table_queries"]

# K-mers and counts.


@query(f"WITH {DOCS}, {valid_words('k', 4, 'seqs')} SELECT {code(4)} AS kmer_id, count(*) AS y FROM k GROUP BY kmer")
def kmer_count_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.kmer_counts(isoforms(spark, sf_dir), 4)


@query(f"WITH {READS}, {valid_words('k', 12, 'reads')} SELECT {code(12)} AS kmer_id, count(*) AS y FROM k GROUP BY kmer")
def kmer_count_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.kmer_counts(reads(spark, sf_dir), 12)


#: Turns with all but their letters left out, so that long k-mers are found.
LETTERS = SEQ.replace("coalesce(text, '')", "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of turns as reads."""
    return read(spark, sf_dir, "conversations").select(from_text(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("sequence"))


@query(f"WITH l AS (SELECT {LETTERS} AS s FROM conversations), {valid_words('k', 15, 'l')} SELECT {code(15)} AS kmer_id, count(*) AS y FROM k GROUP BY kmer")
def kmer_count_minimisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimisers.counts_by_minimiser(letters(spark, sf_dir), 15)


@query(f"WITH l AS (SELECT {LETTERS} AS s FROM conversations), {valid_words('k', 31, 'l')} SELECT {code(31)} AS kmer_id, count(*) AS y FROM k GROUP BY kmer")
def kmer_count_minimisers_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimisers.counts_by_minimiser(letters(spark, sf_dir), 31)


@query(f"WITH {READS}, {valid_words('k', 5, 'reads')} SELECT DISTINCT kmer, {code(5)} AS kmer_id FROM k")
def kmer_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = shred(spread(reads(spark, sf_dir)), 5).distinct().select(F.translate("kmer", "0123", "ACGT").alias("kmer"))
    return words.select("kmer", encode(F.col("kmer")).alias("kmer_id"))


@query(f"WITH {READS}, {valid_words('k', 5, 'reads')} SELECT DISTINCT {code(5)} AS kmer_id, kmer FROM k")
def kmer_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.kmer_counts(reads(spark, sf_dir), 5).select("kmer_id", decode(F.col("kmer_id"), 5).alias("kmer"))


@query(f"WITH b AS (SELECT item_id, {SEQ} AS s FROM benchmark), {valid_words('k', 3, 'b', 'item_id')} SELECT item_id, i - 1 AS position, {code(3)} AS kmer_id FROM k")
def kmer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    return shred_positions(items, 3, "sequence", ("item_id",))


@query(f"""WITH p AS (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY conv_id HAVING count(*) > 1),
ends AS (SELECT {SEQ} AS s FROM conversations c JOIN p ON c.conv_id = p.conv_id AND c.turn IN (p.a, p.b)),
{valid_words("k", 3, "ends")} SELECT {code(3)} AS kmer_id, count(*) AS y FROM k GROUP BY kmer""")
def kmer_count_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = reads(spark, sf_dir)
    pairs = turns.groupBy("conv_id").agg(F.min_by("sequence", "turn").alias("first"), F.max_by("sequence", "turn").alias("second"), F.count("*").alias("n")).where("n > 1")
    return shred_pairs(pairs, 3, "first", "second").groupBy("kmer").agg(F.count("*").alias("y")).select(code_of(F.col("kmer")).alias("kmer_id"), "y")


@query(f"""WITH j AS (SELECT conv_id, string_agg({SEQ}, '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id),
{valid_words('k', 4, 'j')} SELECT {code(4)} AS kmer_id, count(*) AS y FROM k GROUP BY kmer""")
def kmer_count_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.spanning_counts(reads(spark, sf_dir), 4, "conv_id", "turn")


@query(f"WITH {READS}, {y_cte(4)} SELECT r.i AS kmer_id, coalesce(y.y, 0)::BIGINT AS y FROM range(256) r(i) LEFT JOIN y ON y.kmer_id = r.i")
def kmer_space_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.zero_filled(counts.kmer_counts(reads(spark, sf_dir), 4), 4)


@query(f"WITH {READS}, {y_cte(4)} SELECT sum(y)::BIGINT AS n FROM y")
def kmer_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.total(counts.kmer_counts(reads(spark, sf_dir), 4))


@query("WITH " + READS + ", " + ", ".join(valid_words(f"k{k}", k, "reads") for k in (2, 3, 4, 5)) + " " + " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT kmer) AS nnz, count(DISTINCT kmer) / {4**k}.0::DOUBLE AS density FROM k{k}" for k in (2, 3, 4, 5)))
def nnz_density_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.density(reads(spark, sf_dir), [2, 3, 4, 5])


@query("SELECT i AS kmer_id, 1::BIGINT AS y FROM range(1024) r(i)")
def de_bruijn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.kmer_counts(every_kmer(spark, 5), 5)


@query(f"WITH {READS}, {y_cte(3)} SELECT kmer_id, y FROM y")
def kmer_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns arrive in four files, each a batch of its own."""
    arrived = result_path(spark, "arrived")
    reads(spark, sf_dir).select("sequence").repartition(4).write.parquet(arrived)
    stream = spark.readStream.schema("sequence string").option("maxFilesPerTrigger", 1).parquet(arrived)
    return counts_available_now(spark, stream, 3, result_path(spark, "stream"))


# The matrix.


@query(f"WITH {DOCS}, {x_cte(3)} SELECT kmer_id, isoform_id, cnt FROM x")
def kmer_matrix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.build_matrix(isoforms(spark, sf_dir), 3).select("kmer_id", "isoform_id", "cnt")


@query(f"WITH {DOCS}, {x_cte(3)} SELECT kmer_id, isoform_id, cnt, p FROM x")
def kmer_matrix_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.build_matrix(isoforms(spark, sf_dir), 3)


@query(f"""WITH {DOCS}, f AS (SELECT source AS isoform_id, string_agg(s, '' ORDER BY isoform_id) AS s FROM seqs GROUP BY source),
g AS (SELECT isoform_id, CASE WHEN length(s) >= 100 THEN s ELSE '' END AS s FROM f), {x_cte(3, 'g')} SELECT kmer_id, isoform_id, cnt, p FROM x""")
def kmer_matrix_concat_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = isoforms(spark, sf_dir).withColumnRenamed("isoform_id", "seq_idx")
    return matrix.file_matrix(records, 3, "source", "seq_idx", 100)


@query(f"""WITH b AS (SELECT item_id AS isoform_id, {SEQ} AS s FROM benchmark),
r AS (SELECT isoform_id, substr(s, j, 6) AS s FROM (SELECT isoform_id, s, unnest(range(1, length(s) - 4)) AS j FROM b)),
{valid_words('k', 3, 'r', 'isoform_id')} SELECT {code(3)} AS kmer_id, isoform_id, count(*) AS weight, count(*) / sum(count(*)) OVER (PARTITION BY isoform_id) AS p FROM k GROUP BY isoform_id, kmer""")
def read_aware_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("isoform_id"), from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    return matrix.read_aware_matrix(items, 3, 6)


@query(f"""WITH b AS (SELECT item_id AS isoform_id, {SEQ} AS s FROM benchmark), {valid_words('k', 3, 'b', 'isoform_id')},
w AS (SELECT {code(3)} AS kmer_id, isoform_id, sum(1.0::DOUBLE / i) AS weight FROM k GROUP BY isoform_id, kmer)
SELECT kmer_id, isoform_id, round(weight, 9) AS weight, round(weight / sum(weight) OVER (PARTITION BY isoform_id), 9) AS p FROM w""")
def position_weighted_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("isoform_id"), from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    return matrix.weighted_matrix(items, 3, 1.0 / (F.col("position") + 1)).select("kmer_id", "isoform_id", F.round("weight", 9).alias("weight"), F.round("p", 9).alias("p"))


@query(f"WITH {DOCS}, {x_cte(3)} SELECT kmer_id, round(sum(p), 6) AS total FROM x GROUP BY kmer_id")
def row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.row_sums(matrix.build_matrix(isoforms(spark, sf_dir), 3)).select("kmer_id", F.round("total", 6).alias("total"))


@query(f"WITH {READS}, b AS (SELECT item_id AS isoform_id, {SEQ} AS s FROM benchmark), {x_cte(6, 'b')}, {y_cte(6)} SELECT kmer_id, y FROM y WHERE kmer_id IN (SELECT kmer_id FROM x)")
def covered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("isoform_id"), from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    return matrix.covered(counts.kmer_counts(reads(spark, sf_dir), 6), matrix.build_matrix(items, 6))


@query(f"WITH {READS}, b AS (SELECT item_id AS isoform_id, {SEQ} AS s FROM benchmark), {x_cte(6, 'b')}, {y_cte(6)} SELECT kmer_id, y FROM y WHERE kmer_id NOT IN (SELECT kmer_id FROM x)")
def empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("isoform_id"), from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    return matrix.uncovered(counts.kmer_counts(reads(spark, sf_dir), 6), matrix.build_matrix(items, 6))


@query(f"WITH {DOCS}, {x_cte(3)} SELECT count(*) AS nnz FROM x")
def matrix_nnz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.build_matrix(isoforms(spark, sf_dir), 3).agg(F.count("*").alias("nnz"))


@query("WITH e AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL), r AS (SELECT l_partkey, count(*) AS entries FROM e GROUP BY l_partkey) SELECT l_partkey, entries, coalesce(sum(entries) OVER (ORDER BY l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r")
def csr_row_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.row_pointers(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey")


@query(f"WITH {DOCS}, {x_cte(2)} SELECT isoform_id, kmer_id, p, (row_number() OVER (PARTITION BY kmer_id ORDER BY isoform_id) - 1)::BIGINT AS place FROM x")
def matrix_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = matrix.clustered(matrix.build_matrix(isoforms(spark, sf_dir), 2))
    return x.select("isoform_id", "kmer_id", "p", (F.row_number().over(Window.partitionBy("kmer_id").orderBy("isoform_id")) - 1).cast("bigint").alias("place"))


@query(f"SELECT doc_id AS isoform_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS seq_id FROM documents WHERE source NOT LIKE '%7%' AND length({SEQ}) >= 200")
def dense_record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = matrix.keep_records(isoforms(spark, sf_dir), 200, "source", "sequence", "7")
    return matrix.dense_ids(kept.select("isoform_id", "source"), "source", "isoform_id", name="seq_id").select("isoform_id", "seq_id")


# Filters and preparation.


@query("SELECT doc_id, source FROM documents WHERE NOT contains(source, '1')")
def filter_predicted_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.keep_records(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), 0, "source", "text", "1").select("doc_id", "source")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 1000")
def filter_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.keep_records(read(spark, sf_dir, "documents"), 1000, None, "text").select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE NOT contains(text, 'N') AND contains(text, ', ') AND length(text) >= 100")
def clean_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.clean(read(spark, sf_dir, "documents"), "text", "text", ", ").select("doc_id", "source")


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 8 AND regexp_matches(replace(replace(upper(p_type), 'ST', 'NM_'), 'PR', 'XM_'), 'NM|XM')")
def clean_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("name", F.replace(F.replace(F.upper("p_type"), F.lit("ST"), F.lit("NM_")), F.lit("PR"), F.lit("XM_")))
    return prep.clean_strict(part, "name", "p_name", 8).select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def drop_duds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.without(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def quant_left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    quant = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return prep.with_counts(read(spark, sf_dir, "customer").select("c_custkey"), quant, "c_custkey", "n")


@query("SELECT p_partkey, round_even(p_size * 20 / 100.0, 0)::DOUBLE AS reads, round_even(p_size * 20 / 100.0, 0)::DOUBLE * (p_partkey % 3 + 1) / 4 AS size FROM part")
def reads_per_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 3 + 1).alias("fold"))
    return prep.planned_reads(part, "p_size", "fold").select("p_partkey", F.col("reads").cast("double").alias("reads"), F.col("size").cast("double").alias("size"))


HEADERS = "h AS (SELECT source || '_' || (doc_id % 7) || '.' || (doc_id % 3) || ' ' || lang || '_1.2' AS header FROM documents)"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with transcript names made of sources and ids."""
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id") % 7, F.lit("."), F.col("doc_id") % 3, F.lit(" "), "lang", F.lit("_1.2")).alias("header"))


@query(f"WITH {HEADERS}, n AS (SELECT unnest(regexp_extract_all(header, '(\\w*_\\d*\\.\\d*)', 1)) AS name FROM h) SELECT name, count(*) AS n, count(*) / sum(count(*)) OVER () AS theta FROM n GROUP BY name")
def name_counts_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.name_shares(headers(spark, sf_dir))


@query(f"WITH {HEADERS} SELECT split_part(header, ' ', 1) AS id, count(*) AS n, sum(len(regexp_extract_all(header, '(\\w*_\\d*\\.\\d*)', 1)))::BIGINT AS names FROM h GROUP BY 1")
def header_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = headers(spark, sf_dir)
    return named.select(header_id(F.col("header")).alias("id"), F.size(names_in(F.col("header"))).alias("k")).groupBy("id").agg(F.count("*").alias("n"), F.sum("k").cast("bigint").alias("names"))


# Vectors and products.

LENGTHS = "len AS (SELECT isoform_id, s, length(s) - 50 + 1 AS length FROM seqs WHERE length(s) >= 50)"


def lengths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective lengths of isoforms for reads of 50."""
    kept = matrix.keep_records(isoforms(spark, sf_dir), 50, None)
    return kept.select("isoform_id", "sequence", effective_length(F.col("sequence"), 50).alias("length"))


@query(f"WITH {DOCS}, {LENGTHS} SELECT isoform_id, length FROM len")
def effective_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths_of(spark, sf_dir).select("isoform_id", "length")


@query(f"WITH {DOCS}, {LENGTHS} SELECT isoform_id, round((isoform_id + 1) * length / sum((isoform_id + 1.0::DOUBLE) * length) OVER (), 12) AS value FROM len")
def length_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lengths_of(spark, sf_dir)
    return lengths.adjust(known.select("isoform_id", (F.col("isoform_id") + 1.0).alias("value")), known.select("isoform_id", "length")).select("isoform_id", F.round("value", 12).alias("value"))


@query(f"WITH {DOCS}, {LENGTHS} SELECT isoform_id, round((isoform_id + 1.0::DOUBLE) / length / sum((isoform_id + 1.0::DOUBLE) / length) OVER (), 12) AS value FROM len")
def length_adjust_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lengths_of(spark, sf_dir)
    return lengths.adjust_inverse(known.select("isoform_id", (F.col("isoform_id") + 1.0).alias("value")), known.select("isoform_id", "length")).select("isoform_id", F.round("value", 12).alias("value"))


LINE = "m AS (SELECT l_partkey AS kmer_id, l_suppkey AS isoform_id, sum(l_quantity) AS p FROM lineitem GROUP BY ALL)"


def line_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by part and supplier as a sparse matrix."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("kmer_id"), F.col("l_suppkey").alias("isoform_id")).agg(F.sum("l_quantity").alias("p"))


@query(f"WITH {LINE} SELECT kmer_id, round(sum(p / (isoform_id + 1)), 6) AS value FROM m GROUP BY kmer_id")
def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("isoform_id"), (1 / (F.col("s_suppkey") + 1.0)).alias("value"))
    return linalg.spmv(line_matrix(spark, sf_dir), theta).select("kmer_id", F.round("value", 6).alias("value"))


@query(f"WITH {LINE} SELECT isoform_id, round(sum(p * p_size), 6) AS value FROM m JOIN part ON kmer_id = p_partkey GROUP BY isoform_id")
def spmv_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("kmer_id"), F.col("p_size").cast("double").alias("value"))
    return linalg.spmv_t(line_matrix(spark, sf_dir), r).select("isoform_id", F.round("value", 6).alias("value"))


@query(f"WITH {XY} SELECT isoform_id, round(sum(p * y), 6) AS value FROM o GROUP BY isoform_id")
def xy_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = x_and_y(spark, sf_dir)
    return linalg.spmv_t(x, y.select("kmer_id", F.col("y").cast("double").alias("value"))).select("isoform_id", F.round("value", 6).alias("value"))


@query(f"WITH {XY} SELECT kmer_id, isoform_id, p, y FROM o")
def observed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.observed(*x_and_y(spark, sf_dir))


@query("SELECT c_custkey, round(exp(c_acctbal / 1000 - max(c_acctbal / 1000) OVER ()) / sum(exp(c_acctbal / 1000 - (SELECT max(c_acctbal / 1000) FROM customer))) OVER (), 12) AS value FROM customer")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("value"))
    return linalg.softmax(v).select("c_custkey", F.round("value", 12).alias("value"))


@query("WITH v AS (SELECT c_custkey AS i, c_acctbal / 1000 AS v FROM customer UNION ALL SELECT -1, 0.0) SELECT i, round(exp(v - (SELECT max(v) FROM v)) / (SELECT sum(exp(v - (SELECT max(v) FROM v))) FROM v), 12) AS value FROM v")
def softmax_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") / 1000).alias("value"))
    return linalg.softmax0(v, "i").select("i", F.round("value", 12).alias("value"))


@query("SELECT round(sum(abs(c_acctbal)), 4) AS l1, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS l2, max(abs(c_acctbal)) AS linf, min(c_acctbal) FILTER (c_acctbal > 0) AS least_positive FROM customer")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linalg.norms(read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("value")))
    return found.select(F.round("l1", 4).alias("l1"), F.round("l2", 4).alias("l2"), "linf", "least_positive")


@query("SELECT round(sum(ps.p_retailprice * ps.p_size), 2) AS dot FROM part ps")
def dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    found = linalg.dot(part.select("p_partkey", F.col("p_retailprice").alias("value")), part.select("p_partkey", F.col("p_size").alias("value")), "p_partkey")
    return found.select(F.round("dot", 2).alias("dot"))


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN (SELECT min(c_acctbal) FROM customer WHERE c_acctbal > 0) / 10 ELSE c_acctbal END AS value FROM customer")
def clip_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.clipped(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("value")))


# Sampling and simulation.

U = "('0x' || substr(md5('{seed}-' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
CUSTOM = "c AS (SELECT c_custkey AS isoform_id, (c_custkey + 1.0::DOUBLE) / sum(c_custkey + 1.0::DOUBLE) OVER () AS v FROM customer), cum AS (SELECT isoform_id, coalesce(sum(v) OVER (ORDER BY isoform_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, CASE WHEN row_number() OVER (ORDER BY isoform_id DESC) = 1 THEN 2 ELSE sum(v) OVER (ORDER BY isoform_id) END AS high FROM c)"


def custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution over customers."""
    customers = read(spark, sf_dir, "customer")
    return customers.select(F.col("c_custkey").alias("isoform_id"), linalg.share(customers, F.col("c_custkey") + 1.0).alias("value"))


@query(f"WITH {CUSTOM}, d AS (SELECT i AS draw, {U.format(seed=7)} AS u FROM range(5000) r(i)) SELECT draw, isoform_id FROM d JOIN cum ON u >= low AND u < high")
def cdf_and_range_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(custom_weights(spark, sf_dir), sampling.draws(spark, 5000, 7)).select("draw", "isoform_id")


@query(f"WITH {CUSTOM}, d AS (SELECT i AS draw, {U.format(seed=7)} AS u FROM range(5000) r(i)), k AS (SELECT isoform_id, count(*) AS n FROM d JOIN cum ON u >= low AND u < high GROUP BY isoform_id) SELECT c.isoform_id, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / 5000.0::DOUBLE AS share FROM c LEFT JOIN k USING (isoform_id)")
def bincount_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = custom_weights(spark, sf_dir)
    return sampling.bincount(sampling.draw(weights, sampling.draws(spark, 5000, 7)), weights)


@query(f"""WITH {DOCS}, {LENGTHS}, p AS (SELECT isoform_id, s, length, length / sum(length) OVER ()::DOUBLE AS v FROM len),
cum AS (SELECT *, coalesce(sum(v) OVER (ORDER BY isoform_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, CASE WHEN row_number() OVER (ORDER BY isoform_id DESC) = 1 THEN 2 ELSE sum(v) OVER (ORDER BY isoform_id) END AS high FROM p),
d AS (SELECT i AS draw, {U.format(seed=42)} AS u, {U.format(seed=43)} AS w FROM range(3000) r(i)),
j AS (SELECT draw, isoform_id, s, floor(w * length)::BIGINT AS start FROM d JOIN cum ON u >= low AND u < high)
SELECT draw, isoform_id, start, substr(s, start + 1, 50) AS read FROM j""")
def simulate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lengths_of(spark, sf_dir)
    theta = known.select("isoform_id", linalg.share(known, F.col("length")).alias("value"))
    return sampled_reads(known, theta, 3000, 50, 42)


@query(f"""WITH d AS (SELECT {SEQ} AS s, r AS replicate, ('0x' || substr(md5('11-' || r || '-' || conv_id || '-' || turn), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM conversations, range(3) t(r)),
times AS (SELECT replicate, s, {" + ".join(f"(u >= {limit!r}::DOUBLE)::BIGINT" for limit in counts.POISSON)} AS times FROM d), b AS (SELECT * FROM times WHERE times > 0),
{valid_words('k', 3, 'b', 'replicate, times')} SELECT replicate::INT AS replicate, {code(3)} AS kmer_id, sum(times)::BIGINT AS y FROM k GROUP BY replicate, kmer""")
def bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.bootstrap_counts(reads(spark, sf_dir), 3, 3, 11, ("conv_id", "turn"))


@query(f"SELECT i AS id, {U.format(seed=3)} AS u FROM range(1000) r(i)")
def hash_uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1000).select("id", uniform(3, F.col("id")).alias("u"))


# Metrics.

TRUTH = "truth AS (SELECT l_orderkey AS isoform_id, avg(l_quantity) AS t FROM lineitem GROUP BY 1)"


def truth_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of each order, as a truth to compare lines with."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("isoform_id")).agg(F.avg("l_quantity").alias("value"))


@query(f"WITH {TRUTH} SELECT l_linenumber AS iteration, round(sum(abs(l_quantity - t)), 4) AS l1 FROM lineitem JOIN truth ON l_orderkey = isoform_id GROUP BY 1")
def snapshot_l1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("iteration"), F.col("l_orderkey").alias("isoform_id"), F.col("l_quantity").alias("value"))
    return metrics.l1_errors(lines, truth_of(spark, sf_dir)).select("iteration", F.round("l1", 4).alias("l1"))


@query(f"WITH {TRUTH}, d AS (SELECT l_quantity - t AS d FROM lineitem JOIN truth ON l_orderkey = isoform_id WHERE l_linenumber = 1) SELECT round(sum(abs(d)), 4) AS l1, round(sqrt(sum(d * d) / count(*)), 6) AS rmse, round(sqrt(sqrt(sum(d * d)) / count(*)), 6) AS root_norm_by_size FROM d")
def estimate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("isoform_id"), F.col("l_quantity").alias("value"))
    found = metrics.errors(lines, truth_of(spark, sf_dir))
    return found.select(F.round("l1", 4).alias("l1"), F.round("rmse", 6).alias("rmse"), F.round("root_norm_by_size", 6).alias("root_norm_by_size"))


@query(f"WITH {TRUTH} SELECT isoform_id, l_quantity AS estimate, round(l_quantity - t, 6) AS residual FROM lineitem JOIN truth ON l_orderkey = isoform_id WHERE l_linenumber = 1")
def residual_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("isoform_id"), F.col("l_quantity").alias("value"))
    return metrics.residuals(lines, truth_of(spark, sf_dir)).select("isoform_id", "estimate", F.round("residual", 6).alias("residual"))


ESTIMATE = "estimate AS (SELECT l_orderkey AS isoform_id, max(l_quantity) AS e FROM lineitem GROUP BY 1)"


def estimate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest quantity of each order, as one estimate for each from all its lines."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("isoform_id")).agg(F.max("l_quantity").alias("value"))


@query(f"WITH {TRUTH}, {ESTIMATE}, d AS (SELECT e - t AS d FROM estimate JOIN truth USING (isoform_id)) SELECT round(sum(abs(d)), 4) AS l1, round(sqrt(sum(d * d) / count(*)), 6) AS rmse, round(sqrt(sqrt(sum(d * d)) / count(*)), 6) AS root_norm_by_size FROM d")
def order_estimate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.errors(estimate_of(spark, sf_dir), truth_of(spark, sf_dir))
    return found.select(F.round("l1", 4).alias("l1"), F.round("rmse", 6).alias("rmse"), F.round("root_norm_by_size", 6).alias("root_norm_by_size"))


@query(f"WITH {TRUTH}, {ESTIMATE} SELECT isoform_id, e AS estimate, round(e - t, 6) AS residual FROM estimate JOIN truth USING (isoform_id)")
def order_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.residuals(estimate_of(spark, sf_dir), truth_of(spark, sf_dir)).select("isoform_id", "estimate", F.round("residual", 6).alias("residual"))


@query("""WITH r AS (SELECT l_returnflag || l_linestatus AS run, l_linenumber AS iteration, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
e AS (SELECT min(e) AS e FROM (SELECT max(iteration) AS e FROM r GROUP BY run)),
m AS (SELECT iteration, avg(v) AS mean, min(v) AS least, max(v) AS most FROM r WHERE iteration <= (SELECT e FROM e) GROUP BY iteration)
SELECT iteration, round(mean, 0) AS mean, round(least, 2) AS least, round(most, 2) AS most FROM m WHERE iteration <= coalesce((SELECT min(iteration) FROM m WHERE mean <= 1.000001 * (SELECT mean FROM m WHERE iteration = 4)), 99)""")
def curve_min_mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("run"), F.col("l_linenumber").alias("iteration")).agg(F.sum("l_extendedprice").alias("value"))
    limit = metrics.curves(runs).where("iteration = 4").first()["mean"]
    return metrics.curves(runs, 1.000001 * limit).select("iteration", F.round("mean", 0).alias("mean"), *(F.round(c, 2).alias(c) for c in ("least", "most")))
