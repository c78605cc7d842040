"""Queries of the contracts of records, with SQL beside each; relations as in ``run_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators import contracts
from docgrid.plans import run_queries
from docgrid.plans.run_queries import _rules, _with, derived
from docgrid.sources import table

run_queries.DERIVED |= {
    "element_rows": """SELECT CAST(o_custkey AS INT) AS doc_id, CAST(o_orderkey AS INT) AS element_id, CASE o_orderkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'image' ELSE CASE WHEN o_orderkey % 59 = 0 THEN 'chart' ELSE 'table' END END AS type, CAST(o_orderkey % 23 AS INT) AS page, CAST(o_orderkey % 23 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS INT) AS source_page,
 CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 600 END AS DOUBLE) AS page_width, CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 800 END AS DOUBLE) AS page_height, CAST(o_orderkey % 500 - 10 AS DOUBLE) AS x0, CAST(1 AS DOUBLE) AS y0, CAST(o_orderkey % 500 + CASE WHEN o_orderkey % 31 = 0 THEN -20 ELSE 150 END AS DOUBLE) AS x1, CAST(700 AS DOUBLE) AS y1,
 CASE WHEN o_orderkey % 37 <> 0 THEN 't' ELSE '' END AS text, CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 5 <> 0 THEN 'i.png' WHEN o_orderkey % 4 = 3 AND o_orderkey % 13 = 0 THEN 'x.png' END AS image_path, CAST(NULL AS VARCHAR(9)) AS table_image_path, CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 7 <> 0 THEN '|a|' WHEN o_orderkey % 4 = 2 AND o_orderkey % 17 = 0 THEN '|b|' END AS table_markdown,
 CASE WHEN o_orderkey % 6 = 0 THEN 'cap' END AS caption, CASE WHEN o_orderkey % 9 = 0 THEN CASE WHEN o_orderkey % 27 = 0 THEN ' p' ELSE 'p' END END AS provider, CASE WHEN o_orderkey % 2 = 0 THEN 'xyz' ELSE repeat('aB', 32) END AS input_sha256, CAST(o_orderkey % 10 - 1 AS INT) AS reading_order, CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 END AS INT) AS heading_level,
 o_orderkey % 8 <> 0 AS include_in_rag, CASE WHEN o_orderkey % 16 = 0 OR o_orderkey % 41 = 0 THEN 'why' END AS exclusion_reason, o_orderkey % 43 = 0 AS continued, CASE WHEN o_orderkey % 86 = 0 THEN 'g' END AS continuation_group, CASE WHEN o_orderkey % 19 = 0 THEN 'structured' END AS table_status FROM {orders}""",
    "serialized": "SELECT CAST(floor(p_partkey / 8) AS INT) AS doc_id, CAST(floor((p_partkey % 8) / 4) AS INT) AS element_id, CAST(p_partkey % 4 + CASE WHEN p_partkey % 16 = 1 THEN 2 ELSE 1 END AS INT) AS row_index, 'r' || CAST(CASE WHEN p_partkey % 24 = 5 THEN 0 ELSE p_partkey % 4 END AS VARCHAR(9)) AS row_id, CASE WHEN p_partkey % 40 = 7 THEN ' t' ELSE 't' END AS serialized_text FROM {part} WHERE p_partkey % 12 < 10",
    "serialized_tables": "SELECT DISTINCT CAST(floor(p_partkey / 8) AS INT) AS doc_id, CAST(floor((p_partkey % 8) / 4) AS INT) AS element_id, CASE CAST(floor(p_partkey / 4) AS INT) % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'fallback' WHEN 2 THEN 'unavailable' ELSE 'odd' END AS status FROM {part}",
    "entries": "SELECT CAST(floor(p_partkey / 20) AS INT) AS doc_id, CAST(p_partkey % 20 AS INT) AS ord, CAST(p_size % 7 AS INT) AS level, CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_name END AS title, CAST(p_size % 11 AS INT) AS page, CASE WHEN p_partkey % 3 <> 0 THEN p_size / CAST(45 AS DOUBLE) END AS confidence FROM {part}",
    "detected": "SELECT CAST(c_custkey AS INT) AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'digital_outline' WHEN 1 THEN 'digital_reconstructed' ELSE 'scanned_ocr' END AS profile, c_custkey % 2 = 0 AS has_outline, c_custkey % 5 <> 0 AS text_layer, c_custkey % 30 / CAST(25 AS DOUBLE) AS confidence, CAST(c_custkey % 6 + 1 AS INT) AS pages_total, CAST(c_custkey % 4 AS INT) AS a, CAST(c_custkey % 7 AS INT) AS b, CAST(c_custkey % 4 AS INT) AS pages_with_text FROM {customer}",
    "manifests": """SELECT CAST(c_custkey AS INT) AS doc_id, CASE WHEN c_custkey % 31 = 0 THEN '..' ELSE c_name END AS run_id, CASE c_custkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'validated' WHEN 3 THEN 'experimental' ELSE 'done' END AS status, CAST(100 AS INT) AS started_at, CAST(CASE WHEN c_custkey % 3 <> 0 THEN 100 + c_custkey % 4 - 1 END AS INT) AS completed_at,
 CAST(c_custkey % 2 AS INT) AS n_warnings, CAST(c_custkey % 3 AS INT) AS n_errors, 'p' AS profile, CASE WHEN c_custkey % 7 = 0 THEN 'q' ELSE 'p' END AS detected_profile, CASE WHEN c_custkey % 4 = 0 THEN 'o' END AS provider, CASE WHEN c_custkey % 8 = 0 THEN 'm' END AS model, CASE WHEN c_custkey % 11 = 0 THEN 'zz' ELSE repeat('0f', 32) END AS source_sha256,
 CASE WHEN c_custkey % 13 = 0 THEN 'toc.json/x' WHEN c_custkey % 17 = 0 THEN '/abs' ELSE 'manual.json' END AS manual, 'toc.json' AS toc, CASE WHEN c_custkey % 19 = 0 THEN './run.json' END AS validation, 'assets' AS assets, CASE WHEN c_custkey % 23 = 0 THEN 'assets//d' ELSE 'diagnostics' END AS diagnostics FROM {customer}""",
}


def element_contracts(spark: SparkSession, d: str) -> DataFrame:
    return contracts.element_errors(derived(spark, d, "element_rows"))


def table_contracts(spark: SparkSession, d: str) -> DataFrame:
    return contracts.table_errors(derived(spark, d, "serialized"), derived(spark, d, "serialized_tables"))


def outline_contracts(spark: SparkSession, d: str) -> DataFrame:
    return contracts.outline_errors(derived(spark, d, "entries"))


def detection_contracts(spark: SparkSession, d: str) -> DataFrame:
    return contracts.detection_errors(derived(spark, d, "detected").withColumn("sampled_pages", F.array("a", "b")))


def manifest_contracts(spark: SparkSession, d: str) -> DataFrame:
    many = lambda n: F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.col(n))
    return contracts.manifest_errors(derived(spark, d, "manifests").withColumns({"warnings": many("n_warnings"), "errors": many("n_errors")}))


def counter_agreement(spark: SparkSession, d: str) -> DataFrame:
    """What a report counts against its decisions: line items by return flag, told by their orders' status."""
    decisions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("element_id"), F.when(F.col("l_returnflag") == "A", "kept").otherwise("excluded").alias("status"))
    reports = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("kept"), (F.col("o_orderkey") % 4).alias("excluded"))
    return contracts.counter_errors(reports, decisions, ("kept", "excluded"))


QUERIES = {f.__name__: f for f in (element_contracts, table_contracts, outline_contracts, detection_contracts, manifest_contracts, counter_agreement)}

_KIND = "type IN ('image', 'table')"
ORACLE_SQL = {
    "element_contracts": _with("element_rows") + " " + _rules("element_rows", {
        "type": "type = 'chart'", "page": "page < 1", "source_page": "page <> source_page", "bbox": "x1 <= x0", "bbox_inside": "page_width IS NOT NULL AND (x0 < 0 OR x1 > page_width)", "text": "type IN ('title', 'text') AND text = ''", "image_path": "type = 'image' AND image_path IS NULL",
        "image_table": "type = 'image' AND (table_markdown IS NOT NULL OR table_status IS NOT NULL)", "table_source": "type = 'table' AND table_markdown IS NULL", "table_image": "type = 'table' AND image_path IS NOT NULL", "serialization": "table_status IS NOT NULL AND type <> 'table'", "caption": f"caption IS NOT NULL AND NOT {_KIND}",
        "provenance": "provider IS NOT NULL AND (caption IS NULL OR provider <> 'p' OR element_id % 2 = 0)", "reading_order": "reading_order < 0", "heading_level": "heading_level < 1", "exclusion": "include_in_rag = (exclusion_reason IS NOT NULL)", "continued": "continued AND continuation_group IS NULL",
    }, "doc_id, element_id"),
    "table_contracts": _with("serialized", "serialized_tables") + """, r AS (SELECT doc_id, element_id, count(*) AS n, min(row_index) AS a, max(row_index) AS b, count(DISTINCT row_index) AS i, count(DISTINCT row_id) AS ids, count(*) FILTER (serialized_text <> 't') AS blank FROM serialized GROUP BY ALL),
t AS (SELECT s.*, coalesce(n, 0) AS n, a, b, coalesce(i, 0) AS i, coalesce(ids, 0) AS ids, coalesce(blank, 0) AS blank FROM serialized_tables s LEFT JOIN r USING (doc_id, element_id)) """ + _rules("t", {"status": "status = 'odd'", "indexes": "n > 0 AND NOT (a = 1 AND b = n AND i = n)", "ids": "ids <> n", "blank": "blank > 0", "structured": "status = 'structured' AND n = 0", "fallback": "status = 'fallback' AND n <> 1", "unavailable": "status = 'unavailable' AND n > 0"}, "doc_id, element_id"),
    "outline_contracts": _with("entries") + " " + _rules("entries", {"level": "level < 1", "title": "trim(title) = ''", "page": "page < 1", "confidence": "confidence > 1"}, "doc_id, ord"),
    "detection_contracts": _with("detected") + " " + _rules("detected", {"profile": "profile <> CASE WHEN has_outline AND text_layer THEN 'digital_outline' WHEN text_layer THEN 'digital_reconstructed' ELSE 'scanned_ocr' END", "confidence": "confidence > 1", "bounds": "least(a, b) < 1 OR greatest(a, b) > pages_total", "distinct": "a = b", "with_text": "pages_with_text > 2"}),
    "manifest_contracts": _with("manifests") + " " + _rules("manifests", {
        "run_id": "doc_id % 31 = 0", "status": "status = 'done'", "digest": "doc_id % 11 = 0", "identity": "(provider IS NULL) <> (model IS NULL)", "paths": "manual = '/abs'", "overlap": "manual = 'toc.json/x' OR validation IS NOT NULL OR diagnostics = 'assets//d'", "completed": "(status = 'running') = (completed_at IS NOT NULL)",
        "order": "completed_at < started_at", "failed": "status = 'failed' AND n_errors = 0", "errors": "status IN ('validated', 'experimental') AND n_errors > 0", "warned": "status = 'experimental' AND n_warnings = 0", "profile": "status IN ('validated', 'experimental') AND detected_profile = 'q'",
    }),
    "counter_agreement": """WITH c AS (SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'A') AS k, count(*) FILTER (l_returnflag <> 'A') AS e, count(*) - count(DISTINCT l_linenumber) AS t FROM lineitem GROUP BY ALL), r AS (SELECT o_orderkey AS doc_id, coalesce(k, 0) AS k, coalesce(e, 0) AS e, coalesce(t, 0) AS t FROM orders LEFT JOIN c ON c.doc_id = o_orderkey)
""" + _rules("r", {"kept": "k <> 1", "excluded": "e <> doc_id % 4", "ids": "t <> 0"}),
}
