"""The operators over relations that are derived from the driver tables, with SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators import detect, evidence, outline
from docgrid.sources import page_lines, table

LINES_SQL = """lines AS (SELECT doc_id, (i - 1) // 12 + 1 AS page, i - 1 AS line_no, l[i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""
PAGES_SQL = LINES_SQL + r""",
pages_ AS (SELECT doc_id, page, sum(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS chars FROM lines GROUP BY doc_id, page),
totals AS (SELECT doc_id, max(page) AS pages_total FROM pages_ GROUP BY doc_id),
sampled AS (SELECT p.*, t.pages_total FROM pages_ p JOIN totals t USING (doc_id)
  WHERE t.pages_total <= 7 OR list_contains([1 + (i * (t.pages_total - 1)) // 6 FOR i IN range(0, 7)], p.page))"""


def detect_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    outlines = docs.select("doc_id", (F.regexp_extract("source", "[0-9]+", 0).cast("int") % 2 == 0).alias("has_outline"))
    return detect.detect_profile(detect.sampled_characters(page_lines(docs, with_total=True)), outlines)


def page_sampling(spark: SparkSession, d: str) -> DataFrame:
    return detect.sampled_characters(page_lines(table(spark, d, "documents"), with_total=True))


def _toc(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = region.select(F.lit("atlas").alias("doc_id"), F.lit(1).alias("level"), F.col("r_name").alias("title"), (F.col("r_regionkey") * 10 + 1).alias("page"), (F.col("r_regionkey") * 100).alias("ord"))
    return rows.unionByName(nation.select(F.lit("atlas").alias("doc_id"), F.lit(2).alias("level"), F.col("n_name").alias("title"), (F.col("n_regionkey") * 10 + 2 + F.col("n_nationkey") % 5).alias("page"), (F.col("n_regionkey") * 100 + 1 + F.col("n_nationkey")).alias("ord")))


TOC_SQL = """toc AS (SELECT 1 AS level, r_name AS title, r_regionkey * 10 + 1 AS page, r_regionkey * 100 AS ord FROM region
  UNION ALL SELECT 2, n_name, n_regionkey * 10 + 2 + n_nationkey % 5, n_regionkey * 100 + 1 + n_nationkey FROM nation),
chapters AS (SELECT 'atlas' AS doc_id, t.ord, (SELECT max(p.ord) FROM toc p WHERE p.ord < t.ord AND p.level < t.level) AS parent_ord, t.level, t.title, t.page,
  least(60, coalesce((SELECT arg_min(greatest(t.page, n.page - 1), n.ord) FROM toc n WHERE n.ord > t.ord AND n.level <= t.level), 60)) AS page_end FROM toc t)"""


def outline_chapters(spark: SparkSession, d: str) -> DataFrame:
    toc = _toc(spark, d)
    return outline.chapters(toc, toc.select("doc_id", F.lit(60).alias("pages_total")).distinct())


def element_to_chapter(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "orders").select(F.lit("atlas").alias("doc_id"), F.col("o_orderkey").alias("element_id"), (F.col("o_orderkey") % 62 + 1).cast("int").alias("page"))
    return outline.chapter_of(elements, outline_chapters(spark, d))


def monotone_anchor_order(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).alias("anchor"))
    return outline.monotone_anchors(items).select("doc_id", "page", F.col("ord.l_linenumber").alias("line"), "effective")


def roman_depth(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("IV. "), "p_name")).when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.expr("p_partkey div 20").alias("doc_id"), F.col("p_partkey").alias("idx"), title.alias("title"), (F.col("p_size") % 6 + 1).alias("level"))
    return outline.roman_depth(rows)


def namespace_vote(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").select(F.expr("l_orderkey div 10").alias("doc_id"), F.col("l_returnflag").alias("prefix"), F.col("l_linenumber").alias("pdf_page"), (F.col("l_linenumber") - F.col("l_suppkey") % 3).cast("int").alias("printed_page"), F.lit(0.5).alias("confidence"))
    return evidence.namespaces(o).drop("pdf_start")


def repeated_furniture(spark: SparkSession, d: str) -> DataFrame:
    lines = page_lines(table(spark, d, "documents"), 4)
    return evidence.repeated_furniture(lines.select("doc_id", "page", F.lower(F.trim("text")).alias("norm")))


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    pages = detect.page_characters(page_lines(table(spark, d, "documents"), 4)).filter("chars % 3 <> 0")
    return evidence.page_ranges(pages)


def context_top6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), (F.col("turn") % 3 == 0).alias("is_target"))
    return evidence.local_context(rows)


def _visuals(spark: SparkSession, d: str) -> DataFrame:
    area = F.when(F.col("l_linenumber") < 7, F.col("l_quantity") * F.round(F.col("l_discount") * 100) / F.lit(5000.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", area.alias("area_fraction"), (F.col("l_returnflag") != "A").alias("included"))


def crop_filter(spark: SparkSession, d: str) -> DataFrame:
    return evidence.crop_decisions(_visuals(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "status")


def crop_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.crop_decisions(_visuals(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return evidence.duplicate_ids(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("id")), table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("id")))


def report_status(spark: SparkSession, d: str) -> DataFrame:
    return evidence.report_status(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_tax") < 0.07).alias("passed")))


def source_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


QUERIES = {f.__name__: f for f in (detect_profile, page_sampling, outline_chapters, element_to_chapter, monotone_anchor_order, roman_depth, namespace_vote, repeated_furniture, page_ranges, context_top6, crop_filter, crop_counts, duplicate_ids, report_status, source_digest)}

_VISUALS_SQL = """visuals AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 7 THEN l_quantity * round(l_discount * 100) / 5000.0::DOUBLE END AS area, l_returnflag <> 'A' AS included FROM lineitem),
decided AS (SELECT *, CASE WHEN NOT included THEN 'preserved' WHEN area IS NULL THEN 'unassessed' WHEN area < 0.02::DOUBLE THEN 'excluded' ELSE 'kept' END AS status FROM visuals)"""

ORACLE_SQL = {
    "detect_profile": f"""WITH {PAGES_SQL},
s AS (SELECT doc_id, max(pages_total) AS pages_total, count(*) AS sampled, count(*) FILTER (chars >= 40) AS with_text, count(*) FILTER (chars > 0) AS nonempty, median(chars) AS median_chars FROM sampled GROUP BY doc_id),
t AS (SELECT s.*, regexp_extract(d.source, '[0-9]+')::INT % 2 = 0 AS has_outline, with_text >= greatest(1, ceil(sampled * 0.75)) AS text_layer FROM s JOIN documents d USING (doc_id))
SELECT doc_id, pages_total, sampled, with_text, median_chars, text_layer,
 CASE WHEN text_layer AND has_outline THEN 'digital_outline' WHEN text_layer THEN 'digital_reconstructed' ELSE 'scanned_ocr' END AS profile,
 round(CASE WHEN text_layer AND has_outline THEN least(1.0::DOUBLE, 0.92::DOUBLE + 0.08::DOUBLE * (with_text / sampled)) WHEN text_layer THEN least(0.98::DOUBLE, 0.78::DOUBLE + 0.20::DOUBLE * (with_text / sampled))
  ELSE greatest(0.5::DOUBLE, 0.97::DOUBLE - 0.25::DOUBLE * (nonempty / sampled) - CASE WHEN has_outline THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END) END, 3) AS confidence FROM t""",
    "page_sampling": f"WITH {PAGES_SQL} SELECT doc_id, page, chars, pages_total FROM sampled",
    "outline_chapters": f"WITH {TOC_SQL} SELECT * FROM chapters",
    "element_to_chapter": f"""WITH {TOC_SQL}, e AS (SELECT o_orderkey AS element_id, (o_orderkey % 62 + 1)::INT AS page FROM orders)
SELECT 'atlas' AS doc_id, element_id, e.page, arg_max(c.ord, c.level * 1000000 + c.ord) AS chapter_ord, max(c.level) AS chapter_level
FROM e LEFT JOIN chapters c ON e.page BETWEEN c.page AND c.page_end GROUP BY element_id, e.page""",
    "monotone_anchor_order": """SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_linenumber AS line,
 max(CASE WHEN l_quantity > 10 THEN l_quantity::INT ELSE -1 END) OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS effective FROM lineitem""",
    "roman_depth": """WITH r AS (SELECT p_partkey // 20 AS doc_id, p_partkey AS idx, CASE WHEN p_partkey % 10 = 3 THEN 'IV. ' || p_name WHEN p_partkey % 2 = 0 THEN p_size || ' ' || p_name ELSE p_name END AS title, p_size % 6 + 1 AS level FROM part),
s AS (SELECT *, regexp_matches(title, '^[IVXLCDM]+[.)]? ') AS roman, regexp_matches(title, '^[0-9]+([._-][0-9]+)*( |$)') AS numbered FROM r),
t AS (SELECT *, coalesce(bool_or(roman) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM s)
SELECT doc_id, idx, title, level, CASE WHEN inside AND NOT roman AND numbered THEN least(level + 1, 6) ELSE level END AS depth FROM t""",
    "namespace_vote": """WITH o AS (SELECT l_orderkey // 10 AS doc_id, l_returnflag AS prefix, l_linenumber - (l_linenumber - l_suppkey % 3)::INT AS page_offset FROM lineitem),
g AS (SELECT doc_id, prefix, page_offset, count(*) AS support FROM o GROUP BY ALL)
SELECT * FROM g WHERE support >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, prefix ORDER BY support DESC, abs(page_offset), page_offset) = 1""",
    "repeated_furniture": """WITH l AS (SELECT doc_id, (i - 1) // 4 + 1 AS page, lower(trim(t[i])) AS norm FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM l GROUP BY doc_id), s AS (SELECT doc_id, norm, count(DISTINCT page) AS pages FROM l WHERE norm <> '' GROUP BY ALL)
SELECT doc_id, norm, pages FROM s JOIN n USING (doc_id) WHERE pages >= greatest(2, ceil(n * 0.30))""",
    "page_ranges": r"""WITH l AS (SELECT doc_id, (i - 1) // 4 + 1 AS page, t[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
p AS (SELECT doc_id, page FROM l GROUP BY ALL HAVING sum(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))) % 3 <> 0),
g AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p), r AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM g GROUP BY doc_id, g)
SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY doc_id""",
    "context_top6": """WITH n AS (SELECT t.conv_id AS doc_id, t.turn AS target, c.turn AS idx FROM conversations t JOIN conversations c ON t.conv_id = c.conv_id AND t.turn <> c.turn WHERE t.turn % 3 = 0),
r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY abs(idx - target), idx) <= 6)
SELECT doc_id, target::INT AS target, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS context FROM r GROUP BY doc_id, target""",
    "crop_filter": f"WITH {_VISUALS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, status FROM decided",
    "crop_counts": f"WITH {_VISUALS_SQL} SELECT status, count(*) AS n FROM decided GROUP BY status",
    "duplicate_ids": "SELECT doc_id, id, count(*) AS times FROM (SELECT l_orderkey AS doc_id, l_suppkey AS id FROM lineitem UNION ALL SELECT o_orderkey, o_custkey FROM orders) GROUP BY ALL HAVING count(*) > 1",
    "report_status": "SELECT l_orderkey AS doc_id, bool_and(l_tax < 0.07) AS valid, count(*) FILTER (NOT l_tax < 0.07) AS failed FROM lineitem GROUP BY l_orderkey",
    "source_digest": "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes FROM documents",
}
