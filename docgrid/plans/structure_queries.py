"""Queries of the outline, table, caption and bundle operators, with SQL beside each.

The relations are derived from the driver tables by one text of SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.operators import bundle, captions, printed, tables, tree
from docgrid.plans.queries import TOC_SQL, outline_chapters
from docgrid.sources import page_lines, table

DERIVED = {
    "index_lines": """SELECT CAST(floor(p_partkey / 120) AS INT) AS doc_id, CAST(floor((p_partkey % 120) / 10) AS INT) + 1 AS page, CAST(p_partkey % 10 AS INT) AS line_no,
 CASE WHEN p_partkey % 120 = 30 THEN 'Contents' WHEN (p_partkey % 120 >= 30 AND p_partkey % 120 < 50) OR p_partkey % 7 = 0 THEN CAST(p_size % 9 + 1 AS VARCHAR(9)) || '.' || CAST(p_partkey % 5 + 1 AS VARCHAR(9)) || ' ' || p_name || ' .... ' || CAST(p_partkey % 60 + 1 AS VARCHAR(9))
  WHEN p_partkey % 11 = 0 THEN p_name || ' A-' || CAST(p_partkey % 50 AS VARCHAR(9)) ELSE p_name END AS text FROM {part}""",
    "footers": """SELECT CAST(floor(p_partkey / 40) AS INT) AS doc_id, CAST(p_partkey % 40 AS INT) + 1 AS page, CAST(842 AS DOUBLE) AS page_height,
 CAST(CASE WHEN p_partkey % 5 = 4 THEN 400 ELSE 800 END AS DOUBLE) AS y0, CAST(CASE WHEN p_partkey % 5 = 4 THEN 410 ELSE 810 END AS DOUBLE) AS y1,
 CASE WHEN p_partkey % 8 = 4 THEN 'Body-' || CAST(p_partkey % 40 AS VARCHAR(9)) WHEN p_partkey % 4 = 0 THEN 'A-' || CAST(p_partkey % 40 AS VARCHAR(9)) WHEN p_partkey % 4 = 1 THEN '- ' || CAST(p_partkey % 40 AS VARCHAR(9)) || ' -'
  WHEN p_partkey % 4 = 2 THEN ' ' || CAST(p_partkey % 40 AS VARCHAR(9)) || ' ' ELSE p_name END AS text FROM {part}""",
    "refs": "SELECT CAST(floor(p_partkey / 40) AS INT) AS doc_id, CAST(p_partkey AS INT) AS ref_no, CASE WHEN p_partkey % 2 = 0 THEN 'a-' ELSE '' END || CAST(p_partkey % 45 AS VARCHAR(9)) AS page_ref FROM {part}",
    "sized_lines": """SELECT CAST(p_partkey AS INT) AS line, p_size / CAST(2 AS DOUBLE) AS font_size, CASE WHEN p_partkey % 3 = 0 THEN 'Any-Bold' ELSE 'Any' END AS font_name, CAST(p_partkey * 37 % 600 AS DOUBLE) AS x0, CAST(595 AS DOUBLE) AS page_width,
 CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN '1.2 ' || p_name WHEN p_partkey % 5 = 2 THEN 'IV. ' || p_name ELSE p_name END AS text FROM {part}""",
    "match_rows": "SELECT CAST(floor(p_partkey / 40) AS INT) AS doc_id, CAST(p_partkey % 40 AS INT) AS index, CAST(p_size % 9 + 1 AS VARCHAR(9)) || '.1 ' || p_name AS title, CAST(p_partkey % 9 + 1 AS INT) AS resolved_page FROM {part}",
    "match_heads": "SELECT CAST(floor(p_partkey / 40) AS INT) AS doc_id, CAST(p_partkey % 40 AS INT) AS index, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN CAST(p_size % 9 + 1 AS VARCHAR(9)) || '.1 ' || p_name || ' and more' ELSE p_type END AS title, CAST(p_partkey % 11 + 1 AS INT) AS page FROM {part}",
    "vote_rows": "SELECT CAST(floor(p_partkey / 50) AS INT) AS doc_id, p_name AS title, CAST(p_partkey % 50 AS INT) AS printed_page FROM {part}",
    "vote_headings": "SELECT CAST(floor(p_partkey / 50) AS INT) AS doc_id, upper(p_name) AS title, CAST(p_partkey % 50 + 3 + p_partkey % 2 AS INT) AS page FROM {part} WHERE p_partkey % 3 = 0",
    "atlas": """SELECT 'atlas' AS doc_id, 'r' || CAST(r_regionkey AS VARCHAR(20)) AS node_id, CAST(NULL AS VARCHAR(20)) AS parent, CAST(NULL AS VARCHAR(20)) AS grand, r_name AS text FROM {region}
 UNION ALL SELECT 'atlas', 'n' || CAST(n_nationkey AS VARCHAR(20)), 'r' || CAST(n_regionkey AS VARCHAR(20)), NULL, n_name FROM {nation}
 UNION ALL SELECT 'atlas', 'c' || CAST(c_custkey AS VARCHAR(20)), 'n' || CAST(n_nationkey AS VARCHAR(20)), 'r' || CAST(n_regionkey AS VARCHAR(20)), c_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "shared_chapters": """SELECT CAST(floor(p_partkey / 20) AS INT) AS doc_id, CAST(p_partkey % 20 AS INT) AS ord, CAST(p_partkey % 3 AS INT) + 1 AS level, p_name || ' ' || CAST(p_partkey AS VARCHAR(9)) AS title,
 CAST(floor((p_partkey % 20) / 4) AS INT) + 1 AS page, CAST(floor((p_partkey % 20) / 4) AS INT) + 1 + CAST(p_partkey % 3 AS INT) AS page_end FROM {part}""",
    "shared_titles": "SELECT CAST(floor(p_partkey / 20) AS INT) AS doc_id, CAST(floor((p_partkey % 20) / 4) AS INT) + 1 AS page, upper(p_name) || ' - ' || CAST(p_partkey AS VARCHAR(9)) AS text, CAST(p_partkey % 4 AS INT) * 10 + 5 AS reading_order FROM {part} WHERE p_partkey % 3 <> 0",
    "shared_elements": "SELECT CAST(o_orderkey % 10 AS INT) AS doc_id, o_orderkey AS element_id, CAST(floor(o_orderkey / 10) % 6 AS INT) + 1 AS page, CAST(o_custkey % 45 AS INT) AS reading_order FROM {orders}",
    "figure_rows": "SELECT conv_id AS doc_id, CAST(turn AS INT) AS idx, CAST(floor(turn / 3) AS INT) AS page, CASE WHEN turn % 4 = 2 THEN ' fig. ' || CAST(turn AS VARCHAR(9)) ELSE text END AS text FROM {conversations}",
    "captions": """SELECT p_partkey AS element_id, 'Tipo tecnico:  ' || CASE p_partkey % 6 WHEN 0 THEN 'Schema elettrico' WHEN 1 THEN 'schema/diagramma' WHEN 2 THEN 'wiring plan' WHEN 3 THEN 'altro' ELSE 'sicurezza' END || chr(10) || 'Oggetto: ' || p_name || chr(10)
 || 'Elementi visibili: ' || CASE WHEN p_partkey % 4 = 1 THEN 'Cablaggio' ELSE 'vite' END || chr(10) || CASE WHEN p_partkey % 10 = 3 THEN '' ELSE 'Relazioni/funzione: tiene' || chr(10) END || 'Valori/avvertenze: ' || CASE WHEN p_partkey % 3 = 2 THEN 'valore non leggibile' ELSE 'nessuno' END || chr(10)
 || 'Rilevanza RAG: alta' || chr(10) || 'Incertezze: ' || CASE WHEN p_partkey % 2 = 0 THEN 'Nessuna' ELSE 'una' END AS caption FROM {part}""",
    "runs": "SELECT c_custkey AS doc_id, CAST(c_custkey % 7 + 1 AS INT) AS pages_total, CAST(CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 7 ELSE c_custkey % 7 + 1 END AS INT) AS last_page, c_nationkey, c_mktsegment FROM {customer}",
    "run_chapters": "SELECT c_custkey AS doc_id, o.ord AS ord, CAST(CASE WHEN o.ord = 0 THEN NULL ELSE o.ord - 1 END AS INT) AS parent_ord, CASE WHEN c_custkey % 17 = 0 AND o.ord = 2 THEN 2 ELSE o.ord + 1 END AS level, 't' || CAST(o.ord AS VARCHAR(9)) AS title, o.ord + 1 AS page FROM {customer} CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2) o",
    "run_toc": "SELECT c_custkey AS doc_id, o.ord AS ord, CASE WHEN c_custkey % 17 = 0 AND o.ord = 2 THEN 2 ELSE o.ord + 1 END AS level, CASE WHEN c_custkey % 5 = 0 AND o.ord = 1 THEN 'other' ELSE 't' || CAST(o.ord AS VARCHAR(9)) END AS title, o.ord + 1 AS page FROM {customer} CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2) o WHERE c_custkey % 13 <> 0",
    "run_elements": """SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 101 = 0 THEN 7 ELSE o_orderkey END AS element_id, CAST(o_orderkey % 3 AS INT) AS chapter_ord, CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 END AS INT) AS declared_ord, CAST(o_orderkey % 7 AS INT) + 1 AS page,
 CASE WHEN o_orderkey % 5 = 0 THEN 'img/' || CAST(o_orderkey AS VARCHAR(20)) || '.png' WHEN o_orderkey % 13 = 0 THEN '../x' END AS image_path FROM {orders}""",
    "run_files": "SELECT o_custkey AS doc_id, 'img/' || CAST(o_orderkey AS VARCHAR(20)) || '.png' AS path FROM {orders} WHERE o_orderkey % 10 = 0",
    "crop_decided": "SELECT o_custkey AS doc_id, o_orderkey AS element_id, (o_orderkey % 50) / CAST(100 AS DOUBLE) AS area_fraction, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE 'excluded' END AS status FROM {orders} WHERE o_orderkey % 9 <> 0",
    "crop_visuals": "SELECT o_custkey AS doc_id, o_orderkey AS element_id, (o_orderkey % 50 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) / CAST(100 AS DOUBLE) AS area_fraction, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 8 <> 0 THEN 'kept' ELSE 'excluded' END AS status FROM {orders} WHERE o_orderkey % 10 <> 0",
    "artifact_paths": "SELECT CAST(floor(p_partkey / 10) AS INT) AS doc_id, p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'a/b' || CAST(p_partkey % 4 AS VARCHAR(9)) WHEN 1 THEN './a//b' || CAST(p_partkey % 4 AS VARCHAR(9)) || '/c' ELSE 'd' || CAST(p_partkey AS VARCHAR(9)) END AS path FROM {part}",
    "bundle_files": "SELECT CAST(floor(doc_id / 10) AS INT) AS doc_id, 'docs/' || CAST(doc_id AS VARCHAR(20)) || '.txt' AS path, coalesce(text, '') AS content FROM {documents}",
}


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = DERIVED[name]
    used = {t: table(spark, d, t) for t in ("part", "orders", "customer", "region", "nation", "conversations", "documents") if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n].format_map(_Names())})" for n in names)


def _pages(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.max("page").alias("pages_total"))


def toc_page_score(spark: SparkSession, d: str) -> DataFrame:
    lines = derived(spark, d, "index_lines")
    return printed.contents_page_scores(lines, _pages(lines))


def toc_island(spark: SparkSession, d: str) -> DataFrame:
    return printed.contents_pages(toc_page_score(spark, d))


def parse_toc_line(spark: SparkSession, d: str) -> DataFrame:
    t = T.squeeze(F.col("text"))
    lines = derived(spark, d, "index_lines").filter(printed.is_index_line(t))
    return lines.select("doc_id", "page", "line_no", *(c.alias(n) for n, c in printed.index_fields(t, F.when(F.col("page") > 4, 1)).items())).withColumn("confidence", F.round("confidence", 4))


def page_ref_observations(spark: SparkSession, d: str) -> DataFrame:
    return printed.page_ref_observations(derived(spark, d, "footers"))


def page_ref_resolve(spark: SparkSession, d: str) -> DataFrame:
    seen = page_ref_observations(spark, d)
    none = spark.createDataFrame([], "doc_id int, seg int, start_page int, end_page int, prefix string, first_number int, style string")
    direct, offsets = printed.page_number_map(seen, none)
    return printed.resolve_refs(derived(spark, d, "refs"), direct, offsets, _pages(derived(spark, d, "footers")))


def heading_score(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "sized_lines").select("line", F.round(printed.heading_score(F.col("text"), F.lit(10.0)), 4).alias("score"))


def toc_scanner(spark: SparkSession, d: str) -> DataFrame:
    return printed.scan_index_rows(derived(spark, d, "index_lines"))


def fuzzy_title_match(spark: SparkSession, d: str) -> DataFrame:
    """The best heading of a document for each row of its index; headings are titles with a word more or less."""
    return printed.match_headings(derived(spark, d, "match_rows"), derived(spark, d, "match_heads").withColumn("confidence", F.lit(0.5)))


def fold_titles(spark: SparkSession, d: str) -> DataFrame:
    return page_lines(table(spark, d, "documents")).filter("line_no = 0").select("doc_id", T.fold_title(F.col("text")).alias("norm"))


def ocr_offset_vote(spark: SparkSession, d: str) -> DataFrame:
    return tree.offset_vote(derived(spark, d, "vote_rows"), derived(spark, d, "vote_headings"))


def chapter_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.chapter_paths(outline_chapters(spark, d)).select("doc_id", "ord", F.array_join("path", " > ").alias("path"), "depth")


def tree_search(spark: SparkSession, d: str) -> DataFrame:
    nodes = derived(spark, d, "atlas").withColumn("ancestors", F.array_compact(F.array("parent", "grand")))
    return tree.tree_search(nodes, " 07 ").select("doc_id", "node_id")


def same_page_anchor_asof(spark: SparkSession, d: str) -> DataFrame:
    anchored = tree.title_anchors(derived(spark, d, "shared_chapters"), derived(spark, d, "shared_titles"))
    return tree.chapter_at(derived(spark, d, "shared_elements"), anchored)


def figure_lookahead(spark: SparkSession, d: str) -> DataFrame:
    return tree.figure_number(derived(spark, d, "figure_rows"))


def caption_review(spark: SparkSession, d: str) -> DataFrame:
    c = derived(spark, d, "captions").withColumn("canonical", captions.canonical_caption(F.col("caption")))
    return c.select("element_id", "canonical", captions.review_reason(F.col("canonical")).alias("reason"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    pages = F.filter(F.sequence(F.lit(1), F.col("pages_total")), lambda p: p <= F.col("last_page"))
    return derived(spark, d, "runs").withColumn("pages_processed", pages)


def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    return bundle.coverage(_runs(spark, d), derived(spark, d, "run_elements")).withColumn("missing", F.array_join("missing", ","))


def toc_preorder(spark: SparkSession, d: str) -> DataFrame:
    return bundle.toc_differences(derived(spark, d, "run_toc"), derived(spark, d, "run_chapters"))


def asset_anti(spark: SparkSession, d: str) -> DataFrame:
    return bundle.missing_assets(derived(spark, d, "run_elements"), derived(spark, d, "run_files"))


def document_checks(spark: SparkSession, d: str) -> DataFrame:
    return bundle.document_checks(_runs(spark, d), *(derived(spark, d, n) for n in ("run_toc", "run_chapters", "run_elements", "run_files")))


def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    runs = _runs(spark, d).select(
        "doc_id", "pages_total", "pages_processed", F.when(k % 3 == 0, "digital_outline").when(k % 3 == 1, "digital_reconstructed").otherwise("scanned_ocr").alias("profile"),
        F.when(k % 3 == 2, "paddleocr_vl").otherwise("docling").alias("parser"), F.when(k % 3 == 0, bundle.EMBEDDED).when(k % 3 == 1, bundle.PRINTED).otherwise(bundle.SCANNED_PRINTED).alias("strategy"), F.lit(False).alias("has_outline"),
        F.array(F.lower("c_mktsegment"), F.when(k % 4 == 0, "Page 3 TIMED OUT").otherwise("note")).alias("warnings"), (k % 5 != 0).alias("enrichment_ok"), (k % 3).alias("identities"), F.lit(0).alias("reviews"), (k % 2).alias("reviews_declared"),
        F.lit("printed_index").alias("mode"), F.when(k % 4 == 3, 1.0).otherwise(0.9).alias("resolved_ratio"),
    )
    return bundle.promotion_gates(runs)


def crop_enrichment_consistency(spark: SparkSession, d: str) -> DataFrame:
    return bundle.crop_coherence(derived(spark, d, "crop_decided"), derived(spark, d, "crop_visuals"))


def path_collisions(spark: SparkSession, d: str) -> DataFrame:
    return bundle.path_collisions(derived(spark, d, "artifact_paths"))


def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return bundle.fingerprint(derived(spark, d, "bundle_files"))


def table_serialized_text(spark: SparkSession, d: str) -> DataFrame:
    """Markdown tables of five parts each, with an escaped pipe and a repeated header."""
    line = F.format_string("| %s | a\\|%d | %d |", "p_name", "p_partkey", "p_size")
    rows = table(spark, d, "part").groupBy(F.expr("p_partkey div 5").alias("element_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    elements = rows.select(
        F.lit("atlas").alias("doc_id"), "element_id", F.lit(3).alias("page"), F.lit("Guide &amp; parts").alias("manual_title"), F.array(F.lit("Parts "), F.lit(""), F.lit("All")).alias("path"),
        F.lit(None).cast("string").alias("caption_generated"), F.when(F.col("element_id") % 2 == 0, "Table of  parts").alias("caption_original"), F.concat(F.lit("| Name | Key | name |\n|:---|---:|----|\n"), "body").alias("table_markdown"),
    )
    return tables.serialize_tables(elements)


_ALL = (toc_page_score, toc_island, parse_toc_line, page_ref_observations, page_ref_resolve, heading_score, toc_scanner, fuzzy_title_match, fold_titles, ocr_offset_vote, chapter_paths, tree_search, same_page_anchor_asof, figure_lookahead, caption_review, page_coverage, toc_preorder, asset_anti, document_checks, promotion_gates, crop_enrichment_consistency, path_collisions, content_fingerprint, table_serialized_text)
QUERIES = {f.__name__: f for f in _ALL}

_REF = r"([A-Za-z]{1,12}-?)?[0-9]{1,6}"
_MARKED = r"^([0-9]+([._-][0-9]+)*\b|[A-Z](\.[0-9]+)+\b|[IVXLCDM]+\.(\s|$))"
_SCORES = _with("index_lines") + rf""",
n AS (SELECT doc_id, max(page) AS pages_total FROM index_lines GROUP BY doc_id),
f AS (SELECT doc_id, page, lower(string_agg(text, ' ' ORDER BY line_no)) AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS r FROM index_lines) WHERE r <= 12 GROUP BY ALL),
p AS (SELECT doc_id, page, count(*) FILTER (regexp_matches(text, '(\.{{2,}}|\s+){_REF}\s*$')) AS refs, count(*) FILTER (regexp_matches(text, '\.{{3,}}')) AS dots, count(*) FILTER (regexp_matches(text, '{_MARKED}')) AS marks FROM index_lines GROUP BY ALL),
s AS (SELECT p.*, head LIKE '%contents%' OR head LIKE '%indice%' OR head LIKE '%sommario%' AS named FROM p JOIN f USING (doc_id, page) JOIN n USING (doc_id)
  WHERE page <= least(pages_total, greatest(80, ceil(pages_total * 0.25))) OR page >= greatest(1, pages_total - 39)),
scores AS (SELECT doc_id, page, (CASE WHEN named THEN 80 ELSE 0 END + 10 * refs + 7 * least(dots, 10) + 2 * least(marks, 12)) / 10 AS score FROM s WHERE (named OR refs >= 6) AND CASE WHEN named THEN 80 ELSE 0 END + 10 * refs + 7 * least(dots, 10) + 2 * least(marks, 12) >= 80)"""
_SEEN = _with("footers", "refs") + r""",
c AS (SELECT *, trim(text) AS t FROM footers WHERE y0 <= page_height * 0.18::DOUBLE OR y1 >= page_height * (1 - 0.18::DOUBLE)),
o AS (SELECT doc_id, page AS pdf_page, CASE lower(regexp_extract(t, '^([A-Za-z]{1,12})-', 1)) WHEN 'body' THEN '' ELSE lower(regexp_extract(t, '^([A-Za-z]{1,12})-', 1)) END AS prefix, regexp_extract(t, '-([0-9]{1,6})$', 1)::INT AS printed_page, 0.95::DOUBLE AS confidence FROM c WHERE regexp_full_match(t, '[A-Za-z]{1,12}-[0-9]{1,6}')
  UNION ALL SELECT doc_id, page, '', regexp_extract(t, '([0-9]+)', 1)::INT, 0.9::DOUBLE FROM c WHERE regexp_full_match(t, '-\s*[0-9]{1,6}\s*-') UNION ALL SELECT doc_id, page, '', t::INT, 0.7::DOUBLE FROM c WHERE regexp_full_match(t, '[0-9]{1,6}')),
seen AS (SELECT doc_id, pdf_page, prefix, printed_page, max(confidence) AS confidence FROM o GROUP BY ALL)"""
_RUNS = _with("runs", "run_toc", "run_chapters", "run_elements", "run_files") + """,
pages AS (SELECT doc_id, unnest(range(1, last_page + 1)) AS page FROM runs),
cover AS (SELECT p.doc_id, count(e.page) AS covered, ceil(count(*) * 0.75)::BIGINT AS required, coalesce(string_agg(CASE WHEN e.page IS NULL THEN p.page::VARCHAR END, ',' ORDER BY p.page), '') AS missing FROM pages p LEFT JOIN (SELECT DISTINCT doc_id, page FROM run_elements) e USING (doc_id, page) GROUP BY p.doc_id),
differ AS (SELECT coalesce(t.doc_id, c.doc_id) AS doc_id, coalesce(t.ord, c.ord) AS ord FROM run_toc t FULL JOIN run_chapters c ON t.doc_id = c.doc_id AND t.ord = c.ord WHERE t.level IS DISTINCT FROM c.level OR t.title IS DISTINCT FROM c.title OR t.page IS DISTINCT FROM c.page),
absent AS (SELECT doc_id, element_id, image_path FROM run_elements e WHERE image_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_files f WHERE f.doc_id = e.doc_id AND f.path = e.image_path))"""

ORACLE_SQL = {
    "fold_titles": r"""SELECT doc_id, trim(regexp_replace(replace(lower(string_split(text, chr(10))[1]), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS norm FROM documents""",
    "toc_page_score": _SCORES + " SELECT * FROM scores",
    "toc_island": _SCORES + """, g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM scores), r AS (SELECT doc_id, sum(round(score * 10)) AS s, count(*) AS n, min(page) AS a FROM g GROUP BY doc_id, g),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, n DESC, a) = 1) SELECT doc_id, unnest(range(a, a + n))::INT AS page FROM b""",
    "parse_toc_line": _with("index_lines") + rf""", m AS (SELECT *, trim(regexp_replace(regexp_extract(text, '^(.+?)(\.{{2,}}|\s+)({_REF})$', 1), '\.{{2,}}$', '')) AS title, regexp_extract(text, '^(.+?)(\.{{2,}}|\s+)({_REF})$', 3) AS page_ref FROM index_lines WHERE regexp_matches(text, '^(.+?)(\.{{2,}}|\s+)({_REF})$'))
SELECT doc_id, page, line_no, title, page_ref, least(6, CASE WHEN regexp_matches(title, '^[0-9]+([._-][0-9]+)*\b') THEN len(regexp_split_to_array(regexp_extract(title, '^([0-9]+([._-][0-9]+)*)\b', 1), '[._-]')) ELSE 1 END)::INT AS level,
 round(least(1, 0.72::DOUBLE + CASE WHEN page > 4 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(title, '{_MARKED}') THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '\.{{3,}}') THEN 0.04::DOUBLE ELSE 0 END), 4) AS confidence FROM m WHERE length(regexp_replace(title, '[^A-Za-z]', '', 'g')) >= 2""",
    "page_ref_observations": _SEEN + " SELECT * FROM seen",
    "page_ref_resolve": _SEEN + """, n AS (SELECT doc_id, max(page) AS total FROM footers GROUP BY doc_id), direct AS (SELECT doc_id, prefix, printed_page, min(pdf_page) AS p FROM seen WHERE confidence >= 0.85::DOUBLE GROUP BY ALL),
v AS (SELECT doc_id, prefix, pdf_page - printed_page AS o, count(*) AS c, sum(round(confidence * 100)) AS w FROM seen GROUP BY ALL), best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, prefix ORDER BY c DESC, w DESC, abs(o), o) = 1),
r AS (SELECT *, CASE WHEN page_ref LIKE 'a-%' THEN 'a' ELSE '' END AS prefix, regexp_extract(page_ref, '([0-9]+)$', 1)::INT AS number FROM refs),
x AS (SELECT r.*, n.total, coalesce(d.p, r.number + b.o) AS page FROM r LEFT JOIN direct d ON r.doc_id = d.doc_id AND r.prefix = d.prefix AND r.number = d.printed_page LEFT JOIN best b ON r.doc_id = b.doc_id AND r.prefix = b.prefix AND b.c >= 3 LEFT JOIN n ON r.doc_id = n.doc_id)
SELECT doc_id, ref_no, page_ref, CASE WHEN page BETWEEN 1 AND total THEN page END AS resolved_page FROM x""",
    "heading_score": _with("sized_lines") + r""" SELECT line, round(CASE WHEN regexp_matches(text, '^[0-9]+([._-][0-9]+)*\b') OR regexp_matches(text, '^[IVXLCDM]+\.(\s+\S.*)?$') THEN 0.42::DOUBLE ELSE 0::DOUBLE END + CASE WHEN font_size >= 10.8::DOUBLE THEN 0.32::DOUBLE ELSE 0 END
 + CASE WHEN lower(font_name) LIKE '%bold%' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN text = upper(text) THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN x0 <= page_width * 0.30::DOUBLE THEN 0.05::DOUBLE ELSE 0 END, 4) AS score FROM sized_lines""",
    "ocr_offset_vote": _with("vote_rows", "vote_headings") + """, v AS (SELECT r.doc_id, h.page - r.printed_page AS page_offset, count(DISTINCT r.title) AS titles FROM vote_rows r JOIN vote_headings h ON r.doc_id = h.doc_id AND lower(r.title) = lower(h.title) GROUP BY ALL)
SELECT * FROM v WHERE titles >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY titles DESC, abs(page_offset), page_offset) = 1""",
    "chapter_paths": f"""WITH RECURSIVE {TOC_SQL}, w AS (SELECT doc_id, ord, title AS path, 0 AS depth FROM chapters WHERE parent_ord IS NULL UNION ALL SELECT c.doc_id, c.ord, w.path || ' > ' || c.title, w.depth + 1 FROM chapters c JOIN w ON c.parent_ord = w.ord) SELECT * FROM w""",
    "tree_search": _with("atlas") + ", h AS (SELECT * FROM atlas WHERE lower(text) LIKE '%07%') SELECT doc_id, node_id FROM atlas WHERE node_id IN (SELECT node_id FROM h UNION ALL SELECT parent FROM h WHERE parent IS NOT NULL UNION ALL SELECT grand FROM h WHERE grand IS NOT NULL)",
    "same_page_anchor_asof": _with("shared_chapters", "shared_titles", "shared_elements") + r""", c AS (SELECT s.*, t.reading_order AS anchor FROM shared_chapters s LEFT JOIN shared_titles t ON s.doc_id = t.doc_id AND s.page = t.page AND lower(s.title) = lower(regexp_replace(t.text, ' - ', ' '))),
many AS (SELECT doc_id, page FROM shared_chapters GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT e.*, c.ord, CASE WHEN m.page IS NOT NULL AND c.page = e.page AND c.anchor <= e.reading_order THEN 1000000 + c.anchor * 100 + c.ord WHEN m.page IS NULL OR c.page < e.page THEN c.level * 100 + c.ord END AS k FROM shared_elements e JOIN c ON e.doc_id = c.doc_id AND e.page BETWEEN c.page AND c.page_end LEFT JOIN many m ON e.doc_id = m.doc_id AND e.page = m.page)
SELECT e.doc_id, e.element_id, e.page, (SELECT arg_max(ord, k) FROM h WHERE h.element_id = e.element_id AND k IS NOT NULL) AS chapter_ord FROM shared_elements e""",
    "figure_lookahead": _with("figure_rows") + r""", l AS (SELECT *, lead(page) OVER w AS p1, lead(page, 2) OVER w AS p2, lead(text) OVER w AS t1, lead(text, 2) OVER w AS t2 FROM figure_rows WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, CASE WHEN p1 = page THEN coalesce(nullif(regexp_extract(t1, '(?i)^\s*fig\.?\s*([0-9]+)\s*$', 1), ''), CASE WHEN p2 = page THEN nullif(regexp_extract(t2, '(?i)^\s*fig\.?\s*([0-9]+)\s*$', 1), '') END) END AS figure FROM l""",
    "caption_review": _with("captions") + r""", f AS (SELECT *, trim(regexp_extract(caption, '^Tipo tecnico:([^\n]*)', 1)) AS kind, lower(regexp_extract(caption, 'Elementi visibili: ([^\n]*)', 1)) AS seen FROM captions),
k AS (SELECT *, CASE WHEN lower(kind) LIKE '%elettric%' OR lower(kind) LIKE '%wiring%' THEN 'schema elettrico' WHEN lower(kind) IN ('schema/diagramma', 'sicurezza') THEN lower(kind) END AS known FROM f),
v AS (SELECT *, CASE WHEN known IS NOT NULL AND regexp_full_match(caption, 'Tipo tecnico:[^\n]+\nOggetto: [^\n]+\nElementi visibili: [^\n]+\nRelazioni/funzione: [^\n]+\nValori/avvertenze: [^\n]+\nRilevanza RAG: [^\n]+\nIncertezze: [^\n]+') THEN 'Tipo tecnico: ' || known || chr(10) || regexp_extract(caption, '(?s)^[^\n]*\n(.*)$', 1) END AS canonical FROM k)
SELECT element_id, canonical, CASE WHEN canonical IS NULL THEN NULL WHEN known = 'schema elettrico' OR (known = 'schema/diagramma' AND seen LIKE '%cablaggio%') THEN 'generated caption for an electrical schematic requires manual visual review'
 WHEN caption LIKE '%Incertezze: Nessuna%' AND caption LIKE '%non leggibile%' THEN 'generated caption declares no uncertainty but contains an uncertain reading' END AS reason FROM v""",
    "page_coverage": _RUNS + " SELECT doc_id, covered, required, missing, covered >= required AS passed FROM cover",
    "toc_preorder": _RUNS + " SELECT * FROM differ",
    "asset_anti": _RUNS + " SELECT * FROM absent",
    "document_checks": _RUNS + """, bad AS (
 SELECT c.doc_id, 'pages.bounds' AS check_id FROM run_chapters c JOIN runs r USING (doc_id) WHERE c.page > r.pages_total UNION ALL SELECT e.doc_id, 'pages.bounds' FROM run_elements e JOIN runs r USING (doc_id) WHERE e.page > r.pages_total
 UNION ALL SELECT e.doc_id, 'pages.bounds' FROM run_elements e JOIN runs r USING (doc_id) WHERE e.page > r.last_page UNION ALL SELECT doc_id, 'pages.bounds' FROM runs WHERE last_page = 0
 UNION ALL SELECT doc_id, 'pages.content.coverage' FROM cover WHERE covered < required UNION ALL SELECT doc_id, 'pages.content.coverage' FROM runs WHERE last_page = 0
 UNION ALL SELECT doc_id, 'ids.unique' FROM (SELECT doc_id, element_id FROM run_elements GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT doc_id, 'trace.parents.coherent' FROM run_elements WHERE declared_ord IS DISTINCT FROM chapter_ord UNION ALL SELECT c.doc_id, 'trace.parents.coherent' FROM run_chapters c JOIN run_chapters p ON c.doc_id = p.doc_id AND c.parent_ord = p.ord WHERE c.level <= p.level
 UNION ALL SELECT doc_id, 'assets.paths.safe' FROM run_elements WHERE image_path LIKE '..%' UNION ALL SELECT doc_id, 'assets.exist' FROM absent UNION ALL SELECT doc_id, 'toc.hierarchy.coherent' FROM differ UNION ALL SELECT doc_id, 'toc.hierarchy.coherent' FROM runs WHERE doc_id NOT IN (SELECT doc_id FROM run_toc)
 UNION ALL SELECT t.doc_id, 'toc.pages.bounds' FROM run_toc t JOIN runs r USING (doc_id) WHERE t.page > r.pages_total),
every AS (SELECT doc_id, unnest(['pages.bounds', 'pages.content.coverage', 'ids.unique', 'trace.parents.coherent', 'assets.paths.safe', 'assets.exist', 'toc.hierarchy.coherent', 'toc.pages.bounds']) AS check_id FROM runs)
SELECT e.doc_id, e.check_id, count(b.doc_id) = 0 AS passed, count(b.doc_id) AS errors FROM every e LEFT JOIN bad b ON e.doc_id = b.doc_id AND e.check_id = b.check_id GROUP BY ALL""",
    "promotion_gates": _with("runs") + """, g AS (SELECT doc_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS gate_no, doc_id AS k, pages_total, last_page FROM runs)
SELECT doc_id, gate_no, CASE gate_no WHEN 1 THEN 'document.full' WHEN 2 THEN 'enrichment.configured' WHEN 3 THEN 'captions.identity' WHEN 4 THEN 'enrichment.review_free' WHEN 5 THEN 'warnings.nonconsequential' WHEN 6 THEN 'profile.accepted' ELSE 'structure.accepted' END AS gate_id,
 CASE gate_no WHEN 1 THEN last_page = pages_total WHEN 2 THEN k % 5 <> 0 WHEN 3 THEN k % 3 <= 1 WHEN 4 THEN k % 2 = 0 WHEN 5 THEN k % 4 <> 0 WHEN 6 THEN k % 3 <> 2 ELSE k % 3 <> 2 OR k % 4 = 3 END AS passed FROM g""",
    "crop_enrichment_consistency": _with("crop_decided", "crop_visuals") + """, b AS (SELECT coalesce(d.doc_id, v.doc_id) AS doc_id, coalesce(d.element_id, v.element_id) AS element_id, CASE WHEN v.element_id IS NULL THEN 'no_visual' WHEN d.element_id IS NULL THEN 'no_decision' WHEN d.area_fraction <> v.area_fraction THEN 'area' WHEN d.status <> v.status THEN 'status' END AS error FROM crop_decided d FULL JOIN crop_visuals v ON d.element_id = v.element_id AND d.doc_id = v.doc_id) SELECT * FROM b WHERE error IS NOT NULL""",
    "path_collisions": _with("artifact_paths") + """, n AS (SELECT doc_id, name, replace(replace(path, './', ''), '//', '/') AS p FROM artifact_paths) SELECT a.doc_id, a.name, b.name AS other FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.name < b.name AND (a.p = b.p OR starts_with(a.p, b.p || '/') OR starts_with(b.p, a.p || '/'))""",
    "content_fingerprint": _with("bundle_files") + " SELECT doc_id, sha256(string_agg(repeat(chr(0), 7) || chr(strlen(path)::INT) || path || content || chr(0), '' ORDER BY path)) AS sha256 FROM bundle_files GROUP BY doc_id",
    "table_serialized_text": r"""WITH p AS (SELECT *, p_partkey // 5 AS element_id, row_number() OVER (PARTITION BY p_partkey // 5 ORDER BY p_partkey)::INT AS row_index FROM part)
SELECT 'atlas' AS doc_id, element_id, 'structured' AS status, row_index, element_id || '-row-' || lpad(row_index::VARCHAR, 4, '0') AS row_id, 'Manuale: Guide & parts' || chr(10) || 'Percorso capitolo: Parts > All' || chr(10) || 'Pagina PDF: 3' || chr(10) || 'Tabella: ' || element_id || chr(10)
 || 'Descrizione tabella: ' || CASE WHEN element_id % 2 = 0 THEN 'Table of parts' ELSE 'non disponibile' END || chr(10) || 'Riga: ' || row_index || chr(10) || 'Name: ' || p_name || chr(10) || 'Key: a|' || p_partkey || chr(10) || 'name [colonna 3]: ' || p_size AS serialized_text FROM p""",
}
