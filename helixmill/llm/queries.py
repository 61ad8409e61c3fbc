"""The queries of the operators of this subpackage, each over the whole of its tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import bpe, compression, merkle, minhash, mixing, pii, recompression, records, rules, simhash, structure_sql, suffixes, token_counts, turns
from helixmill.llm.common import table


def _over_documents(function: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: scores of all documents by a model of the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return compression.score(docs, compression.train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: statistics and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents")
    return rules.report(docs, rules.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": _over_documents(minhash.near_duplicates),
    "op2_byte_bpe": _over_documents(bpe.digests),
    "op3_source_mixing": _over_documents(mixing.taken),
    "op4_token_records": _over_documents(records.digests),
    "op5_compression_quality": quality,
    "op6_personal_data": _over_documents(pii.report),
    "op7_quality_rules": quality_rules,
    "op8_repeated_passages": _over_documents(lambda docs: recompression.remove_repeats(docs, texts=False)),
    "op9_fingerprints": _over_documents(simhash.compare_edited),
    "op10_token_counts": _over_documents(token_counts.count_tokens),
    "op11_conversation_repair": lambda spark, sf_dir: turns.damage_report(table(spark, sf_dir, "conversations")),
    "op12_dataset_manifest": _over_documents(merkle.report),
    "op13_repeated_bytes": _over_documents(lambda docs: suffixes.remove_repeats(docs, texts=False)),
}

WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": f"""
WITH RECURSIVE listed AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM listed),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, i, n, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, 5))}) AS shingle FROM words)
  WHERE i <= n - 5 OR (n < 5 AND i = 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 75 * (x.n + y.n - met.n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)
""",
    "op8_repeated_passages": f"""
WITH listed AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM listed),
windows AS (
  SELECT doc_id, i, n, md5(concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, 20))})) AS k FROM words),
repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows WHERE i <= n - 20) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM repeats),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k USING (doc_id)
""",
    # Texts as hexadecimal digits, in overlapping blocks of 512 bytes, so that a window is cut out of a short string.
    "op13_repeated_bytes": """
WITH hexed AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, b, substr(h, b * 1024 + 1, 1222) AS h FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 511) // 512)) AS b FROM hexed)),
windows AS (SELECT doc_id, b * 512 + j AS i, md5(substr(h, 2 * j + 1, 200)) AS k FROM (SELECT doc_id, b, h, unnest(range(0, least(512, len(h) // 2 - 99))) AS j FROM blocks WHERE len(h) >= 200)),
repeats AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
runs AS (SELECT doc_id, i, sum((i > before + 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM repeats)),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM spans UNION ALL SELECT doc_id, max(z), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, coalesce(2 * (z - a), len(h))), '' ORDER BY a) AS h FROM edges JOIN hexed USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(z - a)::BIGINT AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM hexed d LEFT JOIN kept k USING (doc_id) LEFT JOIN gone g USING (doc_id)
""",
    "op3_source_mixing": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS h
  FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM total),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM placed),
rated AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS rate
  FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT rate FROM rated WHERE NOT rate * weight > 3 * source_size ORDER BY source_size::DOUBLE / weight, place LIMIT 1),
aimed AS (SELECT source, source_size, least(coalesce((SELECT rate FROM free) * weight, 3.0::DOUBLE * source_size), 3.0::DOUBLE * source_size) AS target FROM rated),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM aimed),
hashes AS (SELECT source, h, sum(size)::BIGINT AS words FROM sized GROUP BY source, h),
summed AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM hashes),
below AS (
  SELECT s.source, s.h, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget, s.upto, s.upto - s.words AS before
  FROM summed s JOIN passed p ON s.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       d.size * (b.whole + (b.upto <= b.budget OR (b.before <= b.budget AND b.upto - b.budget < b.budget - b.before))::BIGINT) AS taken
FROM sized d JOIN below b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h
""",
    "op11_conversation_repair": structure_sql.CONVERSATIONS,
    "op12_dataset_manifest": structure_sql.manifest(),
}
