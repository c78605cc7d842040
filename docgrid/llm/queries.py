"""The ten operators as queries over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm import decontam, exact_dedup, html_text, langid, licenses, line_dedup, mixing, near_dedup, pii, sharding
from docgrid.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it gives away."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))[0]


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its lines, those removed, the runs removed, the digest of what stays, and the words cut inside lines."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    run = F.transform("__runs", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string")))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.coalesce(F.array_join(run, ","), F.lit("")).alias("runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("__n_words_removed").alias("n_words_removed"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_exact_dedup, op4_license_scan, op5_decontaminate, op6_pii, op7_near_dedup, op8_html_text, op9_line_dedup, op10_shards)}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '∅')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number FROM s0),
s2 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(number % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS want, sum(w) OVER () AS ws,
         coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS c, coalesce(sum(w) OVER before, 0.0::DOUBLE) AS v
       FROM s2 WINDOW before AS (ORDER BY cap / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap * (ws - v) <= w * (want - c) AS brim FROM s3),
s5 AS (SELECT *, sum(CASE WHEN brim THEN cap ELSE 0.0::DOUBLE END) OVER () AS fc, sum(CASE WHEN brim THEN w ELSE 0.0::DOUBLE END) OVER () AS fw FROM s4),
s AS (SELECT source, source_size, number, CASE WHEN brim THEN cap ELSE w * (want - fc) / (ws - fw) END AS target FROM s5),
d1 AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM docs),
d2 AS (SELECT d1.*, s.source_size, s.target, s.number, round(s.target)::BIGINT AS words FROM d1 JOIN s ON d1.source IS NOT DISTINCT FROM s.source),
d3 AS (SELECT *, greatest(0, least(size, words - pos)) AS t1, greatest(0, least(size, words - pos - source_size)) AS t2 FROM d2),
d4 AS (SELECT *, least(1.0::DOUBLE, (pos::DOUBLE + t1 / 2.0::DOUBLE) / target) AS share,
         [1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE][(number % 3 + 1)::INT] AS a, [0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE][(number % 3 + 1)::INT] AS b FROM d3)
SELECT doc_id, size, source_size, target, t1 + t2 AS taken,
  CASE WHEN t1 > 0 THEN 2.0::DOUBLE * share / (a + sqrt(greatest(0.0::DOUBLE, a * a + 2.0::DOUBLE * (b - a) * share))) END AS position
FROM d4""",
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}
