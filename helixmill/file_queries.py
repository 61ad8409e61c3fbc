"""Queries that write files and stored tables to the shared folder and read them back, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.bases import effective_length
from helixmill.operators import counts, matrix, prep
from helixmill.plans.simulate import every_kmer, sampled_reads
from helixmill.registry import DOCS, READS, SEQ, XY, isoforms, query, read, reads, x_and_y, x_cte, y_cte
from helixmill.session import result_path
from helixmill.sources import files
from helixmill.sources.store import ModelSettings, Problem, Store, config_hash, merged, write_csv

BARE = f"regexp_replace({SEQ}, '[^ACGT]', '', 'g')"
RECORDS = f"SELECT 'doc ' || doc_id AS header, {BARE} AS sequence FROM documents WHERE {BARE} <> ''"


def bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of valid bases."""
    return isoforms(spark, sf_dir).select(F.concat(F.lit("doc "), "isoform_id").alias("header"), F.regexp_replace("sequence", "[^ACGT]", "").alias("sequence")).where("sequence != ''")


@query(RECORDS)
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "fasta")
    files.write_fasta(bare(spark, sf_dir), path, width=50)
    return files.read_fasta(spark, path).select("header", "sequence")


@query(RECORDS.replace("SELECT 'doc '", "SELECT '>doc '"))
def fasta_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "fasta")
    files.write_fasta(bare(spark, sf_dir), path, width=60)
    return files.read_fasta_native(spark, path).select("header", "sequence")


@query(f"{RECORDS} UNION ALL SELECT 'item ' || item_id, {BARE} FROM benchmark WHERE {BARE} <> ''")
def fasta_of_several_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [result_path(spark, "fasta") for _ in range(2)]
    files.write_fasta(bare(spark, sf_dir), paths[0])
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("b").alias("source"))
    texts = items.select(F.concat(F.lit("item "), "doc_id").alias("header"), F.regexp_replace(F.expr("translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"), "[^ACGT]", "").alias("sequence"))
    files.write_fasta(texts.where("sequence != ''"), paths[1], width=70)
    return files.read_fasta(spark, paths).select("header", "sequence")


@query(RECORDS)
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "fastq")
    files.write_fastq(bare(spark, sf_dir), path)
    return files.read_fastq(spark, path).select("header", "sequence")


@query(f"SELECT doc_id % 7 AS part, count(*) AS records, sum(length({BARE}))::BIGINT AS bases FROM documents WHERE {BARE} <> '' GROUP BY 1")
def fasta_file_for_each_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "parts")
    numbered = bare(spark, sf_dir).withColumn("part", F.split_part("header", F.lit(" "), F.lit(2)).cast("bigint") % 7)
    files.write_fasta_by(numbered, path, "part")
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part")
    return files.read_fasta(spark, f"{path}/*").groupBy(part).agg(F.count("*").alias("records"), F.sum(F.length("sequence")).alias("bases"))


@query("SELECT 'all-4-mers' AS header, 259::BIGINT AS bases, 256::BIGINT AS distinct_words")
def every_kmer_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "all")
    files.write_fasta(every_kmer(spark, 4), path, width=50)
    back = files.read_fasta(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith(">") & (F.length("value") > 50))
    found = counts.kmer_counts(back, 4).where("y = 1").agg(F.count("*").alias("n"))
    return back.select("header", F.length("sequence").cast("bigint").alias("bases")).withColumn("distinct_words", found.scalar()).where(F.lit(lines.isEmpty()))


SIMULATED = "WITH r AS (SELECT range AS draw FROM range(2000)) SELECT 'sim-' || draw || '/' AS start, true AS inside FROM r"


@query(SIMULATED)
def simulated_reads_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated reads under headers of their own number and their isoform's header, each a piece of that isoform."""
    known = isoforms(spark, sf_dir).where(F.length("sequence") >= 30).select("isoform_id", "sequence")
    size = known.select("isoform_id", (effective_length(F.col("sequence"), 30) / known.agg(F.sum(effective_length(F.col("sequence"), 30))).scalar()).alias("value"))
    made = sampled_reads(known, size, 2000, 30, 9).select(F.concat(F.lit("sim-"), F.col("draw").cast("string"), F.lit("/"), F.col("isoform_id").cast("string")).alias("header"), F.regexp_replace("read", "[^ACGT]", "N").alias("sequence"))
    path = result_path(spark, "simulated")
    files.write_fasta(made, path)
    back = files.read_fasta(spark, path).withColumn("isoform_id", F.element_at(F.split("header", "/"), -1).cast("bigint"))
    joined = back.join(known.withColumnRenamed("sequence", "whole"), "isoform_id")
    return joined.select(F.regexp_extract("header", "^(sim-[0-9]+/)", 1).alias("start"), F.contains(F.regexp_replace("whole", "[^ACGT]", "N"), "sequence").alias("inside"))


@query("SELECT 's' || s_suppkey AS Name, s_suppkey % 5 AS NumReads FROM supplier")
def quant_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "quant")
    made = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("Name"), (F.col("s_suppkey") * 10).alias("Length"), (F.col("s_suppkey") % 5).alias("NumReads"))
    made.write.csv(path, sep="\t", header=True, compression="gzip")
    return files.read_quant(spark, path).select("Name", F.col("NumReads").cast("bigint").alias("NumReads"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def duds_from_a_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "duds")
    read(spark, sf_dir, "labels").where("toxic = 1").select(F.concat("doc_id", F.lit(".fa ")).alias("value")).write.text(path)
    duds = files.read_list(spark, path).select(F.col("id").cast("bigint").alias("doc_id"))
    return prep.without(read(spark, sf_dir, "documents").select("doc_id"), duds, "doc_id")


@query("SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = result_path(spark, "csv")
    write_csv(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.csv(path, header=True, schema="n_nationkey int, n_name string")


# Stored tables.

PROBLEM = Problem("documents", N=100, K=3, L=50)


@query(f"WITH {DOCS}, {x_cte(3)} SELECT kmer_id, isoform_id, p FROM x")
def stored_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, result_path(spark, "store"))
    store.save(matrix.build_matrix(isoforms(spark, sf_dir), 3), "x", PROBLEM, cluster="kmer_id")
    return store.load("x", PROBLEM).select("kmer_id", "isoform_id", "p")


@query(f"WITH {XY} SELECT kmer_id, isoform_id, p, y FROM o")
def stored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X and y stored in buckets join as they lie, without an exchange."""
    store = Store(spark, result_path(spark, "store"))
    x, y = x_and_y(spark, sf_dir)
    for kind, table in (("x", x), ("y", y)):
        store.save_bucketed(table, kind, PROBLEM, by="kmer_id", buckets=8)
    return store.load("x", PROBLEM).join(store.load("y", PROBLEM), "kmer_id").select("kmer_id", "isoform_id", "p", "y")


@query(f"WITH {READS}, {y_cte(3)} SELECT kmer_id, y FROM y")
def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are built once, and taken from the store the second time."""
    store, built = Store(spark, result_path(spark, "store")), []

    def build() -> DataFrame:
        built.append(1)
        return counts.kmer_counts(reads(spark, sf_dir), 3)

    store.cached(build, "y", PROBLEM, cluster="kmer_id")
    found = store.cached(build, "y", PROBLEM)
    return found.where(F.lit(len(built) == 1))


@query(f"SELECT doc_id AS isoform_id, length({SEQ}) - 50 + 1 AS length FROM documents WHERE length({SEQ}) >= 50")
def stored_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, result_path(spark, "store"))
    known = matrix.keep_records(isoforms(spark, sf_dir), 50, None).select("isoform_id", effective_length(F.col("sequence"), 50).alias("length"))
    store.save(known, "lengths", PROBLEM)
    return store.load("lengths", PROBLEM)


@query("SELECT l_orderkey AS isoform_id, max(l_quantity) AS value FROM lineitem GROUP BY 1")
def stored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's result under its problem and model; a forced repeat writes over an older one."""
    store, model = Store(spark, result_path(spark, "store")), ModelSettings(solver_name="mg")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("isoform_id"))
    store.cached(lambda: lines.agg(F.min("l_quantity").alias("value")), "run", PROBLEM, model)
    return store.cached(lambda: lines.agg(F.max("l_quantity").alias("value")), "run", PROBLEM, model, force_repeat=True)


@query("SELECT md5('K_' || n_nationkey || '_filename_' || n_name || '_model_' || md5('beta_0.5_name_' || n_regionkey || '_') || '_') AS hash, n_nationkey FROM nation")
def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    made = [(config_hash(merged({"filename": "none", "K": r[0]}, {"filename": r[1], "model": {"name": r[2], "beta": 0.5}})), r[0]) for r in rows]
    return spark.createDataFrame(made, "hash string, n_nationkey int")


@query("SELECT n_nationkey, 'runs/' || md5('Problem_' || md5('K_15_L_100_N_' || (n_nationkey + 1) || '_alpha_0.1_filename_' || n_name || '_') || '_') AS path, n_name || ' N' || (n_nationkey + 1) || ' K15 L100 alpha0.1 simplex mg beta1.0 uniform' AS title FROM nation")
def paths_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, made = Store(spark, "root"), []
    for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        problem = Problem(r["n_name"], N=r["n_nationkey"] + 1)
        made.append((r["n_nationkey"], store.path("runs", problem).removeprefix("root/"), store.title(problem, ModelSettings())))
    return spark.createDataFrame(made, "n_nationkey int, path string, title string")


@query("SELECT count(*) FILTER (c_custkey IS NULL) AS unknown, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) ON o_custkey = c_custkey")
def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a quantification that the records don't have."""
    quant = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    known = read(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")
    return prep.unknown(quant, known, "c_custkey").agg(F.count("*").alias("unknown")).withColumn("n", quant.agg(F.count("*")).scalar())


@query("SELECT coalesce(o.k, l.k) AS key, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS theta, coalesce(q, 0) AS truth FROM (SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 4 <> 1 GROUP BY 1) o FULL JOIN (SELECT c_custkey AS k, c_acctbal AS q FROM customer WHERE c_custkey % 4 <> 2) l ON o.k = l.k")
def counts_beside_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and true abundances by name, where either may lack a name."""
    counted = read(spark, sf_dir, "orders").where("o_custkey % 4 <> 1").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    truth = read(spark, sf_dir, "customer").where("c_custkey % 4 <> 2").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("truth"))
    return prep.beside(counted, truth, "key")
