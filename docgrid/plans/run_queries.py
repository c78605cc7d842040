"""Queries of blocks, assembly, review, prompts and the viewer, with SQL beside each.

As in ``structure_queries``, relations are derived from the driver tables by one text of SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators import assembly, blocks, captions, evidence, geometry, prompts, review, runs, viewer
from docgrid.sources import table

DERIVED = {
    "boxes": """SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, l_partkey, CAST(l_partkey % 900 - 50 AS DOUBLE) AS x0, CAST(l_suppkey % 700 - 20 AS DOUBLE) AS y0, CAST(l_orderkey % 850 AS DOUBLE) AS x1, CAST(l_quantity * 13 AS DOUBLE) AS y1,
 CAST(800 AS DOUBLE) AS page_width, CAST(600 AS DOUBLE) AS page_height, CAST((l_linenumber % 5) * 90 AS INT) AS angle FROM {lineitem}""",
    "ocr_raw": """SELECT CAST(floor(p_partkey / 30) AS INT) AS doc_id, CAST(floor((p_partkey % 30) / 10) AS INT) + 1 AS page, CAST(p_partkey % 10 AS INT) AS block_no,
 CASE p_partkey % 9 WHEN 0 THEN ' Header ' WHEN 1 THEN 'figure_title' WHEN 2 THEN 'doc_title' WHEN 3 THEN 'image' WHEN 4 THEN 'table' ELSE 'text' END AS label, CAST(CASE WHEN p_partkey % 13 = 0 THEN 2 END AS INT) AS title_level,
 CASE WHEN p_partkey % 7 = 6 THEN ' ' WHEN p_partkey % 7 = 5 THEN upper(p_name) WHEN p_partkey % 7 = 4 THEN p_name || chr(10) || '1.2  ' || p_name || chr(10) || ' tail ' || p_name || '.' || chr(10) || 'more' ELSE p_name || '.' END AS text,
 CAST(p_partkey * 7 % 500 AS DOUBLE) AS bx, CAST(p_partkey * 11 % 700 AS DOUBLE) AS by_, CAST(CASE WHEN p_partkey % 10 < 4 THEN 10 - p_partkey % 10 END AS INT) AS block_order, CAST((p_partkey % 2) * 180 AS INT) AS angle FROM {part}""",
    "items": """SELECT CAST(o_custkey AS INT) AS doc_id, CAST(o_orderkey % 4 AS INT) AS parent, CAST(o_orderkey AS INT) AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'chapter' ELSE 'element' END AS kind, CAST(o_orderkey % 5 AS INT) AS page,
 CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 31 % 40 END AS INT) AS at_ FROM {orders}""",
    "results": """SELECT CAST(c_custkey AS INT) AS doc_id, c_name AS run_id, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE c_name END AS manual_id, 'a.pdf' AS source_name, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'a.pdf' END AS source_file, 'en' AS language, 'en' AS asked_language,
 CAST(c_custkey % 9 AS INT) AS pages_total, CAST(c_custkey % 9 + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS INT) AS inspected_pages, c_mktsegment AS profile, CASE WHEN c_custkey % 19 = 0 THEN 'other' ELSE c_mktsegment END AS detected_profile,
 c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_name || ' ' WHEN c_custkey % 7 = 0 THEN 'none' END AS asked_title, c_custkey % 2 = 0 AS toc_available, CAST(c_custkey % 2 + c_custkey % 5 AS INT) AS toc_entries,
 CASE WHEN c_custkey % 23 = 0 THEN ' ' ELSE 'p' END AS parser, 's' AS strategy FROM {customer}""",
    "visuals": """SELECT CAST(o_custkey AS INT) AS doc_id, CAST(o_orderkey AS INT) AS element_id, CAST(o_orderkey AS INT) AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'text' ELSE 'image' END AS type, CAST(o_orderkey % 7 AS INT) AS page, o_orderkey % 5 <> 0 AS include_in_rag,
 CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'visual crop below page-area threshold' WHEN 1 THEN 'caption unavailable after enrichment failure' ELSE 'caption provider unavailable in diagnostic run' END END AS exclusion_reason,
 CASE WHEN o_orderkey % 6 = 2 THEN 'Tipo tecnico: sicurezza' || chr(10) || 'Oggetto: a' || chr(10) || 'Elementi visibili: b' || chr(10) || 'Relazioni/funzione: c' || chr(10) || 'Valori/avvertenze: d' || chr(10) || 'Rilevanza RAG: e' || chr(10) || 'Incertezze: f' WHEN o_orderkey % 31 = 0 THEN 'no caption' END AS caption,
 CASE WHEN o_orderkey % 6 = 2 THEN 'ollama' END AS provider, CASE WHEN o_orderkey % 6 = 2 THEN CASE WHEN o_orderkey % 97 = 0 THEN 'm2' ELSE 'qwen3.5:4b' END END AS model, CAST(NULL AS VARCHAR(30)) AS prompt_version, CASE o_orderkey % 5 WHEN 1 THEN 'fallback' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'structured' END AS table_status FROM {orders}""",
    "enriched": """SELECT CAST(o_custkey AS INT) AS doc_id, CAST(o_orderkey AS INT) AS element_id, CASE o_orderkey % 8 WHEN 0 THEN 'enriched' WHEN 1 THEN 'failed' WHEN 2 THEN 'review_required' ELSE 'skipped' END AS status,
 CASE o_orderkey % 3 WHEN 0 THEN 'visual crop below page-area threshold' WHEN 1 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'table uses structured serialization' ELSE 'caption unavailable after enrichment failure' END ELSE CASE WHEN o_orderkey % 6 = 2 THEN 'caption validated' ELSE 'caption provider unavailable in diagnostic run' END END AS reason FROM {orders} WHERE o_orderkey % 4 <> 1""",
    "crops": """SELECT CAST(o_custkey AS INT) AS doc_id, CAST(o_orderkey AS INT) AS element_id, CASE WHEN o_orderkey % 5 = 0 THEN 'excluded' ELSE 'kept' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'visual crop below page-area threshold' ELSE 'crop area meets page-area threshold' END AS reason FROM {orders} WHERE o_orderkey % 4 <> 1""",
    "set_ups": "SELECT CAST(c_custkey AS INT) AS doc_id, c_custkey % 2 = 0 AS provider_configured, CASE WHEN c_custkey % 3 = 0 THEN 'scanned_ocr' ELSE 'digital_outline' END AS profile, CAST(c_custkey % 12 + 1 AS INT) AS pages_total FROM {customer}",
    "index_rows": "SELECT CAST(floor(p_partkey / 20) AS INT) AS doc_id, CAST(p_partkey % 20 AS INT) AS row_index, CAST(p_partkey % 3 AS INT) + 1 AS level, CASE WHEN p_partkey % 5 = 0 THEN 'Same  title' ELSE p_name END AS title FROM {part}",
    "index_matches": "SELECT CAST(floor(p_partkey / 20) AS INT) AS doc_id, CAST(p_partkey % 20 AS INT) AS ord, CAST((p_partkey + CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END) % 21 AS INT) AS row_index, CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 4 + 1 END AS INT) AS page FROM {part} WHERE p_partkey % 37 <> 0",
    "declared": "SELECT CAST(c_custkey AS INT) AS doc_id, 'check.' || CAST(n.k AS VARCHAR(9)) AS check_id, (c_custkey + n.k) % 5 <> 0 AS passed FROM {customer} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE (c_custkey + n.k) % 11 <> 0",
    "computed": "SELECT CAST(c_custkey AS INT) AS doc_id, 'check.' || CAST(n.k AS VARCHAR(9)) AS check_id, (c_custkey + n.k) % 10 <> 0 AS passed FROM {customer} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE (c_custkey + n.k) % 13 <> 0",
    "named_checks": "SELECT CAST(floor(p_partkey / 15) AS INT) AS doc_id, CAST(p_partkey AS INT) AS ord, CASE p_partkey % 7 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'toc.exists' WHEN 2 THEN 'assets.exist' WHEN 3 THEN 'status.promotion.coherent' WHEN 4 THEN 'other.check' WHEN 5 THEN 'pages.bounds' ELSE 'run_id.coherent' END AS check_id, p_size % 6 <> 0 AS passed FROM {part}",
    "failures": """SELECT CAST(p_partkey AS INT) AS run_id, CASE p_partkey % 3 WHEN 0 THEN 'C:\\dir\\' || p_name || '.pdf' WHEN 1 THEN '/data/' || p_name || '.v2.pdf' ELSE p_name END AS source, '/out/' || CAST(p_partkey AS VARCHAR(9)) AS destination, 'parse' AS stage, 'ValueError' AS error_type, repeat(p_name, 400) AS message FROM {part}""",
    "nodes": """SELECT CAST(floor(p_partkey / 12) AS INT) AS doc_id, CAST(p_partkey AS INT) AS node_id, CAST(p_partkey AS INT) AS ord, CAST(CASE WHEN p_partkey % 12 < 4 THEN NULL ELSE p_partkey - p_partkey % 12 + p_partkey % 2 END AS INT) AS parent, CASE WHEN p_partkey % 12 < 2 THEN 'chapter' WHEN p_partkey % 3 = 0 THEN 'image' ELSE 'text' END AS type,
 CAST(p_partkey % 4 AS INT) + 1 AS page, p_name AS title, CASE WHEN p_partkey % 5 <> 0 THEN repeat(p_name || ' ', 4) END AS text, CASE WHEN p_partkey % 7 = 0 THEN 'cap ' || p_name END AS caption_original FROM {part}""",
    "spoken": """SELECT conv_id AS doc_id, CAST(turn AS INT) AS idx, CAST(turn AS INT) AS element_id, CASE CAST(turn AS INT) % 5 WHEN 0 THEN 'title' WHEN 3 THEN 'image' ELSE 'text' END AS type, CAST(floor(turn / 9) AS INT) AS page, CASE WHEN turn % 4 = 2 THEN 'see fig. ' || CAST(CAST(turn AS INT) % 3 AS VARCHAR(9)) || ' now' ELSE 'words ' || CAST(turn AS VARCHAR(9)) END AS text FROM {conversations}""",
    "asked": "SELECT CAST(c_custkey AS INT) AS doc_id, CAST(c_custkey % 9 + 1 AS INT) AS pages_total, CAST(c_custkey % 8 AS INT) AS a, CAST(c_custkey % 5 AS INT) AS b FROM {customer}",
    "given": "SELECT CAST(o_custkey AS INT) AS doc_id, CAST(o_orderkey % 10 + 1 AS INT) AS page FROM {orders}",
    "addresses": "SELECT CAST(p_partkey AS INT) AS id, CASE p_partkey % 8 WHEN 0 THEN 'a/' || p_name WHEN 1 THEN '../x' WHEN 2 THEN 'a/%2e%2e/b' WHEN 3 THEN 'http://x/y' WHEN 4 THEN '/abs' WHEN 5 THEN 'a\\..\\b' WHEN 6 THEN 'assets//' ELSE ' ' END AS path, CAST(p_partkey % 12000 AS INT) AS page FROM {part}",
    "pipe_tables": """SELECT CAST(p_partkey AS INT) AS id, '| A | B |' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '|---|:-:|' WHEN 1 THEN '|-|-|' ELSE '|x|-|' END || chr(10) || '| ' || p_name || ' | a\\|b |' || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || '| lone |' ELSE '' END AS markdown FROM {part}""",
}


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = DERIVED[name]
    return spark.sql(sql.replace("\\", "\\\\"), **{t: table(spark, d, t) for t in ("part", "orders", "customer", "lineitem", "conversations") if f"{{{t}}}" in sql})


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n].format_map(_Names())})" for n in names)


def rotated_bbox(spark: SparkSession, d: str) -> DataFrame:
    b = derived(spark, d, "boxes")
    box = geometry.placed_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "page_width", "page_height", "angle")))
    return b.select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", *(F.col("b")[k].alias(k) for k in ("x0", "y0", "x1", "y1")))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    box = geometry.box(F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"))
    return derived(spark, d, "boxes").withColumn("b", F.when(F.col("l_linenumber") < 6, box))


def bbox_percentage(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d).withColumn("p", geometry.percentages(F.col("b"), F.col("page_width"), F.col("page_height")))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(F.col("p")[k], 6).alias(k) for k in ("left", "top", "width", "height")))


def area_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The decision of each visual from its box and page."""
    v = _placed(spark, d).withColumn("area_fraction", geometry.share_of_page(F.col("b"), F.col("page_width"), F.col("page_height"))).withColumn("included", F.lit(True))
    return evidence.crop_decisions(v).select("l_orderkey", "l_linenumber", "l_partkey", F.round("area_fraction", 9).alias("area_fraction"), "status")


def _ocr(spark: SparkSession, d: str) -> DataFrame:
    raw = derived(spark, d, "ocr_raw")
    bbox = F.when(F.col("block_no") != 9, F.array(F.col("bx"), F.col("by_"), F.col("bx") + 40, F.col("by_") + 20))
    return raw.withColumns({"bbox": bbox, "page_width": F.lit(600.0), "page_height": F.lit(800.0)})


def ocr_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = blocks.page_elements(_ocr(spark, d))
    return e.select("doc_id", "element_id", "type", "page", "text", "reading_order", "role", "heading_level", "error", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"))


def embedded_titles(spark: SparkSession, d: str) -> DataFrame:
    texts = derived(spark, d, "ocr_raw").filter("text like concat('%', chr(10), '%')").select("doc_id", "page", "block_no", "text")
    return blocks.embedded_titles(texts, "doc_id", "page", "block_no")


def content_order(spark: SparkSession, d: str) -> DataFrame:
    return assembly.content_order(derived(spark, d, "items").withColumnRenamed("at_", "at")).select("doc_id", "parent", "ord", "position")


def root_order(spark: SparkSession, d: str) -> DataFrame:
    return assembly.root_order(derived(spark, d, "items").withColumnRenamed("at_", "at")).select("doc_id", "ord", "position")


def anchor_disorder(spark: SparkSession, d: str) -> DataFrame:
    return assembly.disordered_pages(derived(spark, d, "items").filter("kind = 'chapter'").withColumnRenamed("at_", "anchor"))


def chapter_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    title = F.concat(F.lit("("), "p_name", F.lit(") & "), "p_type" if "p_type" in p.columns else "p_name", F.lit(" "), "p_name")
    return p.select("p_partkey", assembly.chapter_id(F.col("p_partkey"), title).alias("chapter_id"), assembly.section_number(F.concat(F.col("p_size").cast("string"), F.lit(".2 "), "p_name")).alias("number"))


def profile_routing(spark: SparkSession, d: str) -> DataFrame:
    """Each profile's plan over its own documents; the title that a document gets."""
    from docgrid.plans.queries import detect_profile

    plan = lambda name: lambda s: s.select("doc_id", F.lit(name).alias("plan"), assembly.resolved_title(F.when(F.col("doc_id") % 3 == 0, F.lit(" asked ")), F.when(F.col("doc_id") % 2 == 0, F.lit(" ")), F.concat(F.lit("/in/doc."), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("title"))
    return assembly.route(detect_profile(spark, d), {name: plan(name) for name in assembly.PROFILES})


def profile_guards(spark: SparkSession, d: str) -> DataFrame:
    r = derived(spark, d, "results")
    pages = lambda extra: F.filter(F.sequence(F.lit(0), F.col("doc_id") % 4 + extra), lambda p: p > 0)
    r = r.withColumns({"pages_processed": pages(0), "asked_pages": pages(F.when(F.col("doc_id") % 29 == 0, 1).otherwise(0)), "warnings": F.array(F.lit("w"), F.when(F.col("doc_id") % 31 == 0, " ").otherwise("v"))})
    return assembly.result_errors(r)


def page_selection(spark: SparkSession, d: str) -> DataFrame:
    asked = derived(spark, d, "asked").withColumn("asked", F.when(F.col("doc_id") % 4 != 0, F.when(F.col("doc_id") % 10 == 1, F.array().cast("array<int>")).otherwise(F.array("a", "b"))))
    out = assembly.page_selection(asked)
    return out.select("doc_id", F.array_join("pages", ",").alias("pages"), "error")


def page_set(spark: SparkSession, d: str) -> DataFrame:
    pages = derived(spark, d, "asked").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pages_total"))).alias("page"))
    return blocks.page_set_errors(pages, derived(spark, d, "given"))


def page_batches(spark: SparkSession, d: str) -> DataFrame:
    return blocks.batches(derived(spark, d, "given").distinct(), 3)


def element_guards(spark: SparkSession, d: str) -> DataFrame:
    e = derived(spark, d, "visuals").withColumn("element_id", F.when(F.col("element_id") % 50 == 0, 7).otherwise(F.col("element_id")))
    totals = derived(spark, d, "set_ups").select("doc_id", F.lit(6).alias("pages_total"), F.sequence(F.lit(1), F.lit(6)).alias("pages"))
    return assembly.element_errors(e, totals)


def detach_index(spark: SparkSession, d: str) -> DataFrame:
    e = derived(spark, d, "visuals").withColumn("parent", F.col("page"))
    pages = derived(spark, d, "set_ups").filter("profile = 'scanned_ocr'").select("doc_id", F.lit(3).alias("page"))
    return assembly.detach_index(e, pages).select("doc_id", "element_id", "parent", "include_in_rag", "exclusion_reason")


def diagnostic_exclusions(spark: SparkSession, d: str) -> DataFrame:
    out, items = runs.without_captions(derived(spark, d, "visuals"))
    return out.select("doc_id", "element_id", "include_in_rag", "exclusion_reason").join(items.select("doc_id", "element_id", "reason"), ["doc_id", "element_id"], "left")


def table_warnings(spark: SparkSession, d: str) -> DataFrame:
    return runs.table_warnings(derived(spark, d, "visuals"))


def id_differences(spark: SparkSession, d: str) -> DataFrame:
    e, i = (derived(spark, d, n).select("doc_id", F.col("element_id").alias("id")) for n in ("visuals", "enriched"))
    return review.id_differences(e, i.filter("id % 9 <> 0").unionByName(i.filter("id % 9 = 0").select("doc_id", (F.col("id") + 1).alias("id"))))


def enrichment_items(spark: SparkSession, d: str) -> DataFrame:
    return review.item_errors(*(derived(spark, d, n) for n in ("visuals", "enriched", "set_ups")))


def pipeline_transitions(spark: SparkSession, d: str) -> DataFrame:
    return review.transition_errors(*(derived(spark, d, n) for n in ("visuals", "enriched", "crops", "set_ups")))


def trace_exclusions(spark: SparkSession, d: str) -> DataFrame:
    runs_ = derived(spark, d, "set_ups").withColumn("index_pages", F.array(F.lit(1), F.lit(2)))
    return review.exclusion_errors(*(derived(spark, d, n) for n in ("visuals", "enriched", "crops")), runs_)


def caption_consistency(spark: SparkSession, d: str) -> DataFrame:
    return review.caption_errors(derived(spark, d, "visuals"))


def reconstruction_replay(spark: SparkSession, d: str) -> DataFrame:
    return review.replayed_outline(derived(spark, d, "index_rows"), derived(spark, d, "index_matches"))


def replay_errors(spark: SparkSession, d: str) -> DataFrame:
    return review.replay_errors(derived(spark, d, "index_rows"), derived(spark, d, "index_matches"))


def table_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Persisted rows of tables against those that are made anew: some are lost, some changed."""
    from docgrid.plans.structure_queries import table_serialized_text

    made = table_serialized_text(spark, d)
    kept = made.filter("element_id % 7 <> 0").withColumn("serialized_text", F.when((F.col("element_id") % 5 == 0) & (F.col("row_index") == 2), "x").otherwise(F.col("serialized_text")))
    return review.serialization_errors(kept, made)


def source_agreement(spark: SparkSession, d: str) -> DataFrame:
    r = derived(spark, d, "results")
    r = r.select("doc_id", "run_id", "manual_id", F.col("pages_total").alias("manual_pages"), F.col("inspected_pages").alias("source_pages"), F.col("source_file").alias("manual_file"), F.col("source_name").alias("source_file"), F.col("detected_profile").alias("manual_profile"), "profile", F.col("parser").alias("manual_parser"), F.lit("p").alias("parser"), F.lit("s").alias("manual_strategy"), "strategy", "toc_available", "toc_entries")
    return review.source_errors(r)


def _captioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Runs and elements with the set-up of their captions."""
    k = F.col("doc_id")
    r = derived(spark, d, "set_ups").select(
        "doc_id", "provider_configured", F.lit("ollama").alias("provider"), F.lit("qwen3.5:4b").alias("model"), F.col("provider_configured").alias("enabled"), F.when(k % 7 == 0, "v1").otherwise(captions.CURRENT).alias("prompt_version"), F.when(k % 9 == 0, 900).otherwise(1200).alias("max_characters"),
        F.lit("qwen3.5:4b").alias("preflight_model"), F.when(k % 5 == 0, "0.x").when(k % 11 == 0, " 1.0").otherwise("0.34.0").alias("preflight_version"), F.when(k % 13 == 0, "abc").otherwise(F.repeat(F.lit("a"), F.lit(64))).alias("preflight_digest"), F.repeat(F.lit("a"), F.lit(64)).alias("accepted_digest"),
        F.create_map(F.lit("model"), F.when(k % 17 == 0, "other").otherwise("qwen3.5:4b"), F.lit("num_ctx"), F.lit("4096")).alias("provider_config"),
    )
    known = F.col("provider").isNotNull()
    e = derived(spark, d, "visuals").withColumns({"prompt_version": F.when(known, captions.CURRENT), "runtime_version": F.when(known & (F.col("element_id") % 41 != 0), "0.34.0"), "params": F.create_map(F.lit("num_ctx"), F.when(F.col("element_id") % 29 == 0, "1").otherwise("4096"))})
    return r, e


def caption_identity(spark: SparkSession, d: str) -> DataFrame:
    return review.identity_errors(*_captioned(spark, d))


def caption_parameters(spark: SparkSession, d: str) -> DataFrame:
    r, e = _captioned(spark, d)
    return review.parameter_errors(e, r)


def enrichment_evidence(spark: SparkSession, d: str) -> DataFrame:
    r, e = _captioned(spark, d)
    return review.enrichment_evidence(r, e, derived(spark, d, "enriched").filter("element_id % 3 = 0"))


def report_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every run's checks of what it says in several places, from the errors of each."""
    source = source_agreement(spark, d)
    errors = {
        "run_id.coherent": source.filter("error = 'run_id'"), "source.coherent": source.filter("error <> 'run_id'"), "captions.provenance.consistent": caption_consistency(spark, d), "captions.provenance.identity": caption_identity(spark, d),
        "promotion.evidence.coherent": enrichment_items(spark, d).unionByName(pipeline_transitions(spark, d)).unionByName(trace_exclusions(spark, d)), "validation.artifact": report_compare(spark, d), "pages.content": page_set(spark, d),
    }
    return review.report_checks(derived(spark, d, "set_ups"), errors)


def profile_reasons(spark: SparkSession, d: str) -> DataFrame:
    from docgrid.operators import detect
    from docgrid.plans.queries import detect_profile

    entries = F.when(F.regexp_extract("source", "[0-9]+", 0).cast("int") % 2 == 0, 3).otherwise(0)
    return detect.reasons(detect_profile(spark, d), table(spark, d, "documents").select("doc_id", entries.alias("entries"))).select("doc_id", F.array_join("reasons", "|").alias("reasons"))


def status_promotion(spark: SparkSession, d: str) -> DataFrame:
    from docgrid.plans.structure_queries import promotion_gates

    return review.unsupported_status(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, "validated").otherwise("experimental").alias("status")), promotion_gates(spark, d))


def report_compare(spark: SparkSession, d: str) -> DataFrame:
    return review.report_differences(derived(spark, d, "declared"), derived(spark, d, "computed"))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    none = derived(spark, d, "index_rows").select("doc_id")
    return review.run_metrics(derived(spark, d, "set_ups"), none, derived(spark, d, "visuals"), none.filter("doc_id % 2 = 0"), derived(spark, d, "given").filter("page = 1"), derived(spark, d, "declared"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.status_counts(derived(spark, d, "enriched"), "enriched", "review_required", "skipped", "failed")


def failure_reports(spark: SparkSession, d: str) -> DataFrame:
    f = derived(spark, d, "failures")
    at = lambda s: F.timestamp_micros(F.col("run_id").cast("long") * 1_000_003 + s)
    r = runs.failure_reports(f.withColumns({"started_at": at(5_000_000), "failed_at": at(F.when(F.col("run_id") % 9 == 0, 0).otherwise(9_000_000))}))
    return r.select("run_id", "source_file", F.sha2("error_message", 256).alias("message_sha256"), F.length("error_message").alias("n"), "report_name", "coherent")


def run_ids(spark: SparkSession, d: str) -> DataFrame:
    f = derived(spark, d, "failures")
    named = runs.run_id(F.col("source"), F.timestamp_micros(F.col("run_id").cast("long") * 1_000_003))
    return f.select("run_id", named.alias("id"), runs.fallback_id(F.when(F.col("run_id") % 2 == 0, F.lit("a/b")), F.when(F.col("run_id") % 3 == 0, F.lit(" x")), F.when(F.col("run_id") % 5 == 0, F.lit("ok"))).alias("fallback"))


def pipeline_selection(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each run's configuration that say what was selected."""
    s = derived(spark, d, "set_ups").select(
        "doc_id", "profile", F.lit("p").alias("parser"), F.lit("s").alias("strategy"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("model"), "pages_total", F.sequence(F.lit(1), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(F.col("pages_total"))).alias("pages_processed"),
        F.lit(0.5).alias("confidence"), F.lit(0.02).alias("threshold"), F.lit("bbox_area_fraction_v1").alias("crop_strategy"), F.col("provider_configured").alias("enabled"), F.lit(captions.CURRENT).alias("prompt_version"), F.lit(1200).alias("max_characters"),
    )
    c = runs.pipeline_selection(s)
    return c.select("doc_id", "profile", *(F.get_json_object("config", p).alias(n) for n, p in (("selection", "$.pages.selection"), ("processed", "$.pages.processed"), ("enabled", "$.enrichment.enabled"), ("detected", "$.routing.detected_profile"))))


def caption_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    text = prompts.prompt(
        F.lit("Guide"), F.when(k % 2 == 0, "image").otherwise("table"), k, F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("One"), F.col("p_name"))), F.when(k % 5 == 0, F.col("p_name")), F.when(k % 4 == 0, F.lit("")).otherwise(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(300))),
        F.when(k % 2 == 1, F.concat(F.lit("| a |  b |\n"), "p_name")), k % 7 != 0, F.when(k % 9 == 0, "technical-caption-v2").otherwise(captions.CURRENT),
    )
    return p.select("p_partkey", F.sha2(text, 256).alias("prompt_sha256"), prompts.request_digest(k.cast("string"), F.lit("image"), text, F.when(k % 2 == 0, F.encode("p_name", "UTF-8"))).alias("input_sha256"))


def context_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts about each third turn of a conversation, among those of its page."""
    rows = derived(spark, d, "spoken").withColumns({"path": F.array((F.col("idx") % 2).cast("string")), "caption_original": F.lit(None).cast("string"), "text": F.when(F.col("idx") % 7 != 0, F.col("text"))})
    return prompts.page_context(rows, rows.filter("idx % 3 = 0").select("doc_id", "idx"))


def figure_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "spoken")
    targets = rows.filter("type = 'image'").select("doc_id", "idx", "page", ((F.col("idx") + 2) % 3).cast("string").alias("figure"))
    return prompts.figure_context(rows, targets).select("doc_id", "idx", F.array_join("titles", "|").alias("titles"), "context")


def check_families(spark: SparkSession, d: str) -> DataFrame:
    return viewer.check_families(derived(spark, d, "named_checks"))


def first_failed(spark: SparkSession, d: str) -> DataFrame:
    """The first three failed checks of each report."""
    return viewer.first_failed(derived(spark, d, "named_checks"), 3)


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return viewer.type_counts(derived(spark, d, "nodes"), "chapter", "image", "text")


def record_labels(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "nodes").select("node_id", viewer.record_label(*(F.col(c) for c in ("type", "title", "caption_original", "text", "page"))).alias("label"))


def node_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return viewer.neighbours(derived(spark, d, "nodes").select("doc_id", "ord", "node_id", "page"))


def tree_lines(spark: SparkSession, d: str) -> DataFrame:
    """The tree of each document as it is drawn."""
    return viewer.tree_lines(derived(spark, d, "nodes"))


def safe_addresses(spark: SparkSession, d: str) -> DataFrame:
    a = derived(spark, d, "addresses")
    return a.select("id", viewer.safe_address(F.col("path")).alias("safe"), viewer.page_raster(F.col("path"), F.col("page")).alias("raster"))


def shown_tables(spark: SparkSession, d: str) -> DataFrame:
    t = derived(spark, d, "pipe_tables").withColumn("rows", viewer.shown_table(F.col("markdown")))
    return t.select("id", F.size("rows").alias("n_rows"), F.array_join(F.get("rows", F.lit(2)), ";").alias("third")).withColumn("n_rows", F.when(F.col("n_rows") >= 0, F.col("n_rows")))


def description_fields(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("a:b: "), "p_name", F.lit("\n\n c : "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "\nplain").otherwise(""))
    p = table(spark, d, "part").select("p_partkey", viewer.description_fields(text).alias("f"))
    return p.select("p_partkey", F.array_join(F.transform("f", lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";").alias("fields"))


def rebuilt_commands(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    line = viewer.command(F.lit("docgrid"), F.concat(F.lit("in/"), "c_name", F.when(k % 2 == 0, "'s.pdf").otherwise(".pdf")), F.concat(F.lit("run-"), k.cast("string")), F.when(k % 3 == 0, "1-3,5"), k % 5 == 0, k % 7 != 0)
    return table(spark, d, "customer").select("c_custkey", line.alias("command"))


def run_contradictions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    r = derived(spark, d, "results").select("doc_id", "run_id", "manual_id", F.col("source_name").alias("source_file"), F.col("source_file").alias("manual_file"), "profile", "detected_profile", F.col("profile").alias("manual_profile"), F.when(k % 2 == 0, F.col("manual_id")).alias("report_id"), F.when(k % 2 == 0, F.when(k % 6 == 0, "failed").otherwise("passed")).alias("report_status"), F.when(k % 3 == 0, "validated").otherwise("experimental").alias("status"))
    return viewer.contradictions(r)


def bundle_agreement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    r = derived(spark, d, "results").select("doc_id", F.when(k % 37 == 0, "a/b").otherwise(F.col("run_id")).alias("run_id"), "manual_id", F.col("run_id").alias("report_id"), F.when(k % 6 == 0, "failed").otherwise("passed").alias("report_status"), F.when(k % 3 == 0, "validated").otherwise("rejected").alias("status"))
    return review.bundle_errors(r)


_ALL = (
    rotated_bbox, bbox_percentage, area_fraction, ocr_blocks, embedded_titles, content_order, root_order, anchor_disorder, chapter_ids, profile_routing, profile_guards, page_selection, page_set, page_batches, element_guards, detach_index, diagnostic_exclusions, table_warnings,
    id_differences, enrichment_items, pipeline_transitions, trace_exclusions, caption_consistency, reconstruction_replay, replay_errors, table_agreement, source_agreement, caption_identity, caption_parameters, enrichment_evidence, report_checks, profile_reasons, status_promotion, report_compare, run_metrics, status_counts, failure_reports, run_ids,
    pipeline_selection, caption_prompts, context_texts, figure_sections, check_families, first_failed, type_counts, record_labels, node_neighbours, tree_lines, safe_addresses, shown_tables, description_fields, rebuilt_commands, run_contradictions, bundle_agreement,
)
QUERIES = {f.__name__: f for f in _ALL}

_FOUR = "CASE WHEN {0} > 9999 THEN {0}::VARCHAR ELSE lpad({0}::VARCHAR, 4, '0') END"
_CUT = "CASE WHEN {0} < 0 THEN 0::DOUBLE WHEN {0} > {1} THEN {1} ELSE {0} END"
_BOXES = _with("boxes") + f""",
s AS (SELECT *, CASE WHEN angle IN (90, 270) THEN page_height ELSE page_width END AS wide, CASE WHEN angle IN (90, 270) THEN page_width ELSE page_height END AS high FROM boxes),
c AS (SELECT *, {_CUT.format("x0", "wide")} AS a0, {_CUT.format("x1", "wide")} AS a1, {_CUT.format("y0", "high")} AS b0, {_CUT.format("y1", "high")} AS b1 FROM s),
t AS (SELECT *, least(a0, a1) AS l, greatest(a0, a1) AS r, least(b0, b1) AS o, greatest(b0, b1) AS u FROM c),
good AS (SELECT *, r - l > 1 AND u - o > 1 AND angle < 360 AS ok FROM t)"""
_PLACED = _with("boxes") + ", p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber < 6 AS has, least(x0, x1) AS x0, greatest(x0, x1) AS x1, least(y0, y1) AS y0, greatest(y0, y1) AS y1 FROM boxes)"
_LETTERS = r"length(regexp_replace({0}, '\P{{L}}', '', 'g'))"
_TITLE = (
    r"(length({0}) BETWEEN 1 AND 120 AND len(string_split({0}, ' ')) <= 12 AND NOT contains({0}, '...') AND NOT regexp_matches({0}, '[.;,]$') AND length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) >= 2"
    r" AND (regexp_matches({0}, '^[0-9]+([._-][0-9]+)*\b') OR length(regexp_replace({0}, '[^A-Z]', '', 'g')) >= 0.75 * length(regexp_replace({0}, '[^A-Za-z]', '', 'g'))))"
)
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CANONICAL = "caption LIKE 'Tipo tecnico:%'"


def _segments(source: str) -> str:
    """Lines of (doc_id, page, block_no, text) of a relation, cut into segments."""
    return f"""l AS (SELECT doc_id, page, block_no, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {source})),
k AS (SELECT *, {_TITLE.format(_SQUEEZED.format("line"))} AS t FROM l), m AS (SELECT *, t OR coalesce(lag(t) OVER w, true) AS starts FROM k WINDOW w AS (PARTITION BY doc_id, page, block_no ORDER BY i)),
g AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY doc_id, page, block_no ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM m),
seg AS (SELECT doc_id, page, block_no, segment::INT AS segment, CASE WHEN bool_or(t) THEN 'title' ELSE 'text' END AS type, CASE WHEN bool_or(t) THEN trim(string_agg(line, chr(10) ORDER BY i)) ELSE string_agg(line, chr(10) ORDER BY i) END AS text FROM g GROUP BY ALL)"""


_RANKS = """CASE WHEN split_part(check_id, '.', 1) IN ('run', 'manifest', 'artifacts', 'diagnostics', 'validation') THEN 0 WHEN split_part(check_id, '.', 1) IN ('manual', 'toc', 'pages', 'ids', 'trace', 'source', 'run_id') THEN 1 WHEN split_part(check_id, '.', 1) IN ('assets', 'captions', 'tables') THEN 2 WHEN split_part(check_id, '.', 1) IN ('promotion', 'status') THEN 3 ELSE 4 END"""
_STATES = _with("visuals", "enriched", "crops", "set_ups") + """,
valid AS (SELECT *, caption LIKE 'Tipo tecnico:%' AS ok, caption IS NOT NULL AND caption NOT LIKE 'Tipo tecnico:%' AS broken, provider IS NOT NULL AS known FROM visuals),
e AS (SELECT v.*, i.status, i.reason, s.provider_configured AS conf, s.profile AS prof FROM enriched i JOIN valid v USING (doc_id, element_id) JOIN set_ups s USING (doc_id))"""


def _rules(source: str, rules: dict[str, str], key: str = "doc_id", name: str = "error") -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS {name} FROM {source} WHERE {r}" for n, r in rules.items())


_PROMPT_SQL = "concat(" + ", ".join(
    "'" + part.replace("'", "''") + "'" if k % 2 == 0 else f"({{{part}}})" for k, part in enumerate(__import__("re").split(r"\{(\w+)\}", prompts.PROMPT))
) + ")"
_FILL = {
    "visual": f"CASE WHEN p_partkey % 7 <> 0 THEN '{prompts.WITH_IMAGE.replace(chr(39), chr(39) * 2)}' ELSE '{prompts.WITHOUT_IMAGE.replace(chr(39), chr(39) * 2)}' END", "title": "'Guide'", "type": "CASE WHEN p_partkey % 2 = 0 THEN 'image' ELSE 'table' END", "page": "p_partkey::VARCHAR",
    "chapter": "CASE WHEN p_partkey % 3 = 0 THEN 'Non disponibile' ELSE 'One > ' || p_name END", "original": "CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'Non disponibile' END",
    "context": "CASE WHEN p_partkey % 4 = 0 THEN 'Non disponibile' WHEN length(trim(repeat(p_name || ' ', 300))) <= 2400 THEN trim(repeat(p_name || ' ', 300)) ELSE substr(repeat(p_name || ' ', 300), 1, 2399) || '…' END",
    "table": "CASE WHEN p_partkey % 2 = 1 THEN chr(10) || 'Markdown tabella originale:' || chr(10) || '| a | b | ' || p_name ELSE '' END", "format": f"CASE WHEN p_partkey % 9 = 0 THEN '{prompts.STRICT.format(1200)}' ELSE '{prompts.ADVISED.format(1200)}' END",
}

ORACLE_SQL = {
    "rotated_bbox": _BOXES + """ SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN CASE angle WHEN 0 THEN l WHEN 90 THEN page_width - u WHEN 180 THEN page_width - r ELSE o END END AS x0, CASE WHEN ok THEN CASE angle WHEN 0 THEN o WHEN 90 THEN l WHEN 180 THEN page_height - u ELSE page_height - r END END AS y0,
 CASE WHEN ok THEN CASE angle WHEN 0 THEN r WHEN 90 THEN page_width - o WHEN 180 THEN page_width - l ELSE u END END AS x1, CASE WHEN ok THEN CASE angle WHEN 0 THEN u WHEN 90 THEN r WHEN 180 THEN page_height - o ELSE page_height - l END END AS y1 FROM good""",
    "bbox_percentage": _PLACED + f""", q AS (SELECT *, {_CUT.format("(x0 / 800 * 100)", "100::DOUBLE")} AS a, {_CUT.format("(x1 / 800 * 100)", "100::DOUBLE")} AS b, {_CUT.format("(y0 / 600 * 100)", "100::DOUBLE")} AS c, {_CUT.format("(y1 / 600 * 100)", "100::DOUBLE")} AS e FROM p), z AS (SELECT *, has AND b > a AND e > c AS ok FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN round(a, 6) END AS "left", CASE WHEN ok THEN round(c, 6) END AS top, CASE WHEN ok THEN round(b - a, 6) END AS width, CASE WHEN ok THEN round(e - c, 6) END AS height FROM z""",
    "area_fraction": _PLACED + ", q AS (SELECT *, CASE WHEN has THEN (x1 - x0) * (y1 - y0) / (800::DOUBLE * 600::DOUBLE) END AS f FROM p) SELECT l_orderkey, l_linenumber, l_partkey, round(f, 9) AS area_fraction, CASE WHEN f IS NULL THEN 'unassessed' WHEN f < 0.02::DOUBLE THEN 'excluded' ELSE 'kept' END AS status FROM q",
    "ocr_blocks": _with("ocr_raw") + rf""",
a AS (SELECT *, lower(trim(label)) AS role FROM ocr_raw WHERE lower(trim(label)) <> 'header'),
b AS (SELECT *, CASE WHEN role = 'figure_title' THEN 'text' WHEN title_level > 0 OR role = 'doc_title' THEN 'title' WHEN role IN ('image', 'table') THEN role ELSE 'text' END AS kind,
  list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), 'string_agg', chr(10)) AS lines FROM a),
c AS (SELECT * EXCLUDE (kind, text), CASE WHEN kind = 'text' AND NOT contains(coalesce(lines, ''), chr(10)) AND {_TITLE.format("lines")} THEN 'title' ELSE kind END AS kind, CASE WHEN kind = 'table' THEN trim(text) ELSE coalesce(lines, '') END AS text FROM b),
d AS (SELECT *, CASE WHEN block_no = 9 THEN NULL WHEN angle = 0 THEN bx ELSE 600 - least(600, bx + 40) END AS x0, CASE WHEN block_no = 9 THEN NULL WHEN angle = 0 THEN least(800, by_ + 20) ELSE 800 - by_ END AS y1,
  CASE WHEN block_order IS NOT NULL THEN 0 WHEN block_no <> 9 THEN 1 ELSE 2 END AS tier, CASE WHEN block_order IS NOT NULL THEN block_order WHEN block_no <> 9 THEN by_ ELSE block_no END AS k1, CASE WHEN block_order IS NULL AND block_no <> 9 THEN bx ELSE 0 END AS k2 FROM c WHERE kind NOT IN ('title', 'text') OR text <> ''),
many AS (SELECT doc_id, page, block_no, text FROM d WHERE kind = 'text' AND contains(text, chr(10))),
{_segments("many")},
cut AS (SELECT * FROM seg WHERE (doc_id, page, block_no) IN (SELECT (doc_id, page, block_no) FROM seg WHERE type = 'title')),
e AS (SELECT d.doc_id, d.page, coalesce(cut.type, d.kind) AS type, coalesce(cut.text, d.text) AS text, CASE WHEN cut.type = 'title' THEN d.role || ':embedded_title' ELSE d.role END AS role, CASE WHEN cut.type IS NULL AND title_level > 0 THEN title_level END AS heading_level,
  CASE WHEN d.kind IN ('image', 'table') AND block_no = 9 THEN 'no_box' END AS error, x0, y1, tier, k1, k2, d.block_no AS n, coalesce(cut.segment, 0) AS s FROM d LEFT JOIN cut USING (doc_id, page, block_no)),
f AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page, tier, k1, k2, n, s) - 1)::INT AS reading_order, row_number() OVER (PARTITION BY doc_id, page, type ORDER BY tier, k1, k2, n, s) AS no FROM e)
SELECT doc_id, 'paddle-' || type || '-' || lpad(page::VARCHAR, 4, '0') || '-' || lpad(no::VARCHAR, 4, '0') AS element_id, type, page, nullif(text, '') AS text, reading_order, role, heading_level, error, x0, y1 FROM f""",
    "embedded_titles": _with("ocr_raw") + ", many AS (SELECT doc_id, page, block_no, text FROM ocr_raw WHERE contains(text, chr(10))), " + _segments("many") + " SELECT * FROM seg",
    "content_order": _with("items") + """, p AS (SELECT *, CASE WHEN kind = 'chapter' THEN max(coalesce(at_, -1)) OVER (PARTITION BY doc_id, parent, kind, page ORDER BY ord ROWS UNBOUNDED PRECEDING) ELSE coalesce(at_, 0) END AS place FROM items)
SELECT doc_id, parent, ord, row_number() OVER (PARTITION BY doc_id, parent ORDER BY page, place, CASE WHEN kind = 'chapter' THEN 0 ELSE 1 END, ord) - 1 AS position FROM p""",
    "root_order": _with("items") + " SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, CASE WHEN kind = 'chapter' THEN 0 ELSE 1 END, CASE WHEN kind = 'chapter' THEN 0 ELSE coalesce(at_, 0) END, ord) - 1 AS position FROM items",
    "anchor_disorder": _with("items") + ", b AS (SELECT doc_id, page, at_ < lag(at_) OVER (PARTITION BY doc_id, page ORDER BY ord) AS back FROM items WHERE kind = 'chapter' AND at_ IS NOT NULL) SELECT DISTINCT doc_id, page FROM b WHERE back",
    "chapter_ids": f"SELECT p_partkey, 'chapter-' || {_FOUR.format('(p_partkey + 1)')} || '-' || substr(regexp_replace(regexp_replace(lower('(' || p_name || ') & ' || p_type || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48) AS chapter_id, p_size || '.2' AS number FROM part",
    "profile_guards": _with("results") + ", bad AS (" + _rules("results", {
        "id": "manual_id IS DISTINCT FROM run_id", "source": "source_file IS NULL", "pages_total": "doc_id % 17 = 0", "pages": "doc_id % 29 = 0 AND doc_id % 4 + 1 > 0", "profile": "doc_id % 19 = 0", "title": "doc_id % 3 <> 0 AND doc_id % 7 = 0", "toc": "toc_available <> (toc_entries > 0)", "set_up": "doc_id % 23 = 0", "warnings": "doc_id % 31 = 0",
    }, name="guard") + ") SELECT * FROM bad",
    "page_selection": _with("asked") + """, q AS (SELECT *, doc_id % 4 <> 0 AS has, doc_id % 10 = 1 AS none FROM asked), r AS (SELECT *, CASE WHEN NOT has THEN NULL WHEN none THEN 'empty' WHEN a = b THEN 'repeated' WHEN least(a, b) < 1 OR greatest(a, b) > pages_total THEN 'outside' END AS error FROM q)
SELECT doc_id, CASE WHEN NOT has THEN (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM range(1, pages_total + 1) t(i)) WHEN error IS NULL THEN least(a, b) || ',' || greatest(a, b) END AS pages, error FROM r""",
    "page_set": _with("asked", "given") + """, a AS (SELECT doc_id, unnest(range(1, pages_total + 1))::INT AS page FROM asked), g AS (SELECT doc_id, page, count(*) AS n FROM given GROUP BY ALL)
SELECT coalesce(a.doc_id, g.doc_id) AS doc_id, coalesce(a.page, g.page) AS page, CASE WHEN a.doc_id IS NULL THEN 'unrequested' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS error FROM a FULL JOIN g ON a.doc_id = g.doc_id AND a.page = g.page WHERE a.doc_id IS NULL OR n IS NULL OR n > 1""",
    "page_batches": _with("given") + " SELECT doc_id, page, ((row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) // 3)::INT AS batch FROM (SELECT DISTINCT * FROM given)",
    "element_guards": _with("visuals", "set_ups") + ", v AS (SELECT doc_id, CASE WHEN element_id % 50 = 0 THEN 7 ELSE element_id END AS element_id, page FROM visuals) SELECT doc_id, element_id, 'duplicate_id' AS error FROM v GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, element_id, 'page' FROM v JOIN set_ups USING (doc_id) WHERE page > 6 OR page < 1",
    "detach_index": _with("visuals", "set_ups") + ", v AS (SELECT v.*, s.doc_id IS NOT NULL AS x FROM visuals v LEFT JOIN set_ups s ON v.doc_id = s.doc_id AND s.profile = 'scanned_ocr' AND v.page = 3) SELECT doc_id, element_id, CASE WHEN NOT x THEN page END AS parent, include_in_rag AND NOT x AS include_in_rag, CASE WHEN x THEN 'printed table-of-contents source page' ELSE exclusion_reason END AS exclusion_reason FROM v",
    "diagnostic_exclusions": _with("visuals") + """, r AS (SELECT *, CASE WHEN NOT include_in_rag THEN exclusion_reason WHEN type = 'table' THEN 'table uses structured serialization' WHEN caption IS NOT NULL THEN 'caption already present' ELSE 'caption provider unavailable in diagnostic run' END AS why FROM visuals),
g AS (SELECT *, type = 'image' AND include_in_rag AND caption IS NULL AS gone FROM r) SELECT doc_id, element_id, include_in_rag AND NOT gone AS include_in_rag, CASE WHEN gone THEN why ELSE exclusion_reason END AS exclusion_reason, CASE WHEN type <> 'text' THEN why END AS reason FROM g""",
    "table_warnings": _with("visuals") + ", t AS (SELECT doc_id, coalesce(string_agg(CASE WHEN table_status = 'fallback' THEN element_id::VARCHAR END, ', ' ORDER BY ord), '') AS fallback, coalesce(string_agg(CASE WHEN coalesce(table_status, 'unavailable') = 'unavailable' THEN element_id::VARCHAR END, ', ' ORDER BY ord), '') AS unavailable FROM visuals WHERE type = 'table' AND include_in_rag GROUP BY doc_id) SELECT * FROM t WHERE fallback <> '' OR unavailable <> ''",
    "id_differences": _with("visuals", "enriched") + ", i AS (SELECT DISTINCT doc_id, CASE WHEN element_id % 9 = 0 THEN element_id + 1 ELSE element_id END AS id FROM enriched), e AS (SELECT DISTINCT doc_id, element_id AS id FROM visuals) (SELECT *, 'left' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM i)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM i EXCEPT SELECT * FROM e))",
    "enrichment_items": _STATES + """, j AS (SELECT *, CASE status WHEN 'enriched' THEN conf AND ok AND known AND include_in_rag AND reason = 'caption validated' WHEN 'review_required' THEN false
 WHEN 'skipped' THEN coalesce(NOT include_in_rag AND reason = exclusion_reason, false) OR (coalesce(caption, '') <> '' AND known AND include_in_rag AND reason = 'caption already present') OR (type = 'table' AND include_in_rag AND caption IS NULL AND NOT known AND reason = 'table uses structured serialization')
 ELSE coalesce(conf AND type = 'image' AND caption IS NULL AND NOT known AND NOT include_in_rag AND exclusion_reason = 'caption unavailable after enrichment failure', false) END AS good FROM e)
SELECT doc_id, element_id AS id, CASE WHEN broken THEN 'invalid_caption' ELSE 'status' END AS error FROM j WHERE broken OR NOT coalesce(good, false)""",
    "pipeline_transitions": _STATES + """, j AS (SELECT e.*, c.status AS crop, c.reason AS why FROM e JOIN crops c USING (doc_id, element_id)), k AS (SELECT *, CASE WHEN crop IN ('excluded', 'preserved') THEN status = 'skipped' AND NOT include_in_rag AND reason = why AND reason = exclusion_reason WHEN status = 'enriched' THEN include_in_rag WHEN status = 'review_required' THEN NOT include_in_rag
 WHEN status = 'failed' THEN type = 'image' AND NOT include_in_rag AND exclusion_reason = 'caption unavailable after enrichment failure' WHEN type = 'table' AND status = 'skipped' AND reason = 'table uses structured serialization' AND include_in_rag THEN true WHEN status = 'skipped' AND reason = 'caption already present' AND include_in_rag THEN true
 WHEN conf THEN false ELSE status = 'skipped' AND reason = 'caption provider unavailable in diagnostic run' AND NOT include_in_rag AND exclusion_reason = 'caption provider unavailable in diagnostic run' END AS good FROM j) SELECT doc_id, element_id AS id, 'transition' AS error FROM k WHERE NOT coalesce(good, false)""",
    "trace_exclusions": _STATES + """, j AS (SELECT v.doc_id, v.element_id, v.type, v.page, v.exclusion_reason AS why, i.status, i.reason, c.status AS crop, s.provider_configured AS conf, s.profile FROM visuals v LEFT JOIN enriched i USING (doc_id, element_id) LEFT JOIN crops c USING (doc_id, element_id) JOIN set_ups s USING (doc_id) WHERE NOT include_in_rag)
SELECT doc_id, element_id AS id, 'exclusion' AS error FROM j WHERE NOT (coalesce(why = 'visual crop below page-area threshold' AND type IN ('image', 'table') AND crop = 'excluded', false) OR coalesce(why = 'caption provider unavailable in diagnostic run' AND type = 'image' AND NOT conf AND status = 'skipped' AND reason = why, false)
 OR coalesce(why = 'caption unavailable after enrichment failure' AND type = 'image' AND conf AND status = 'failed', false))""",
    "caption_consistency": _STATES + " " + _rules("valid", {"not_visual": "caption IS NOT NULL AND type = 'text'", "no_provenance": "caption IS NOT NULL AND NOT known", "no_caption": "known AND caption IS NULL", "image_without": "type = 'image' AND include_in_rag AND caption IS NULL", "invalid": "broken"}, "doc_id, element_id AS id"),
    "reconstruction_replay": _with("index_rows", "index_matches") + r""", j AS (SELECT m.doc_id, m.ord, r.level, r.title, m.page FROM index_matches m JOIN index_rows r USING (doc_id, row_index) WHERE m.page IS NOT NULL),
f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, level, lower(regexp_replace(title, '\s+', ' ', 'g')), page ORDER BY ord) = 1) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, level, title, page FROM f""",
    "replay_errors": _with("index_rows", "index_matches") + ", m AS (SELECT doc_id, row_index, count(*) AS n FROM index_matches GROUP BY ALL) SELECT coalesce(r.doc_id, m.doc_id) AS doc_id, coalesce(r.row_index, m.row_index) AS row_index, CASE WHEN r.doc_id IS NULL THEN 'no_row' WHEN n IS NULL THEN 'no_match' ELSE 'repeated' END AS error FROM index_rows r FULL JOIN m ON r.doc_id = m.doc_id AND r.row_index = m.row_index WHERE r.doc_id IS NULL OR n IS NULL OR n > 1",
    "table_agreement": "WITH e AS (SELECT p_partkey // 5 AS element_id, count(*) AS n FROM part GROUP BY ALL) SELECT 'atlas' AS doc_id, element_id, CASE WHEN element_id % 7 = 0 THEN 'missing' ELSE 'differs' END AS error FROM e WHERE element_id % 7 = 0 OR (element_id % 5 = 0 AND n >= 2)",
    "source_agreement": _with("results") + " " + _rules("results", {"pages_total": "pages_total <> inspected_pages", "source_file": "source_file IS NULL", "profile": "profile <> detected_profile", "parser": "parser <> 'p'", "toc": "toc_available <> (toc_entries > 0)", "run_id": "run_id <> manual_id"}),
    "caption_identity": _with("visuals", "set_ups") + """, seen AS (SELECT doc_id, count(DISTINCT model) AS ids, min(model) AS model, bool_or(element_id % 41 = 0) AS bare FROM visuals WHERE provider IS NOT NULL GROUP BY doc_id),
r AS (SELECT s.doc_id, s.doc_id AS k, provider_configured AS enabled, coalesce(ids, 0) AS ids, model, coalesce(bare, false) AS bare FROM set_ups s LEFT JOIN seen USING (doc_id)) """ + _rules("r", {
        "identities": "ids > 1", "identity": "ids = 1 AND model <> 'qwen3.5:4b'", "prompt": "(enabled OR ids > 0) AND k % 7 = 0", "prompts": "ids > 0 AND k % 7 = 0", "length": "(enabled OR ids > 0) AND k % 9 = 0", "preflight_version": "(enabled OR ids > 0) AND k % 5 <> 0 AND k % 11 = 0",
        "digest": "(enabled OR ids > 0) AND k % 13 = 0", "release": "(enabled OR ids > 0) AND k % 7 <> 0 AND (k % 5 = 0 OR k % 11 = 0)", "accepted_digest": "(enabled OR ids > 0) AND k % 13 = 0", "runtime": "ids > 0 AND (bare OR k % 5 = 0 OR k % 11 = 0)",
    }),
    "report_compare": _with("declared", "computed") + " SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, coalesce(d.check_id, c.check_id) AS check_id, CASE WHEN d.passed IS NULL THEN 'undeclared' WHEN c.passed IS NULL THEN 'unknown' ELSE 'differs' END AS error FROM declared d FULL JOIN computed c ON d.doc_id = c.doc_id AND d.check_id = c.check_id WHERE d.passed IS DISTINCT FROM c.passed",
    "run_metrics": _with("visuals", "set_ups", "index_rows", "given", "declared") + """ SELECT s.doc_id, pages_total AS source_pages_total, (SELECT count(*) FROM index_rows i WHERE i.doc_id = s.doc_id) AS chapter_count, count(v.doc_id) AS element_count, count(DISTINCT v.page) AS element_page_count, count(*) FILTER (caption IS NOT NULL) AS caption_count, count(*) FILTER (type = 'table') AS table_count,
 count(*) FILTER (type = 'table' AND table_status = 'structured') AS table_structured_count, count(*) FILTER (type = 'table' AND table_status = 'fallback') AS table_fallback_count, count(*) FILTER (type = 'table' AND table_status = 'unavailable') AS table_unavailable_count, (SELECT count(*) FROM index_rows i WHERE i.doc_id = s.doc_id AND i.doc_id % 2 = 0) AS toc_entry_count,
 (SELECT count(*) FROM given g WHERE g.doc_id = s.doc_id AND g.page = 1) AS table_row_count, (SELECT count(*) FROM declared d WHERE d.doc_id = s.doc_id AND NOT d.passed) AS failed_check_count FROM set_ups s LEFT JOIN visuals v USING (doc_id) GROUP BY s.doc_id, pages_total""",
    "status_counts": _with("enriched") + " SELECT doc_id, count(*) FILTER (status = 'enriched') AS enriched, count(*) FILTER (status = 'review_required') AS review_required, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM enriched GROUP BY doc_id",
    "failure_reports": _with("failures") + """, t AS (SELECT *, run_id::BIGINT * 1000003 + CASE WHEN run_id % 9 = 0 THEN 0 ELSE 9000000 END AS us FROM failures) SELECT run_id, CASE run_id % 3 WHEN 0 THEN regexp_replace(source, '^.*\\\\', '') WHEN 1 THEN replace(source, '/data/', '') ELSE source END AS source_file, sha256(substr(message, 1, 4000)) AS message_sha256, least(4000, length(message))::INT AS n,
 run_id || '.failure-' || strftime(make_timestamp(us), '%Y%m%dT%H%M%S%f') || 'Z' AS report_name, run_id % 9 <> 0 AS coherent FROM t""",
    "run_ids": _with("failures") + r""" SELECT run_id, regexp_replace(regexp_replace(lower(CASE run_id % 3 WHEN 0 THEN regexp_replace(regexp_replace(source, '^.*\\', ''), '\.pdf$', '') WHEN 1 THEN regexp_replace(replace(source, '/data/', ''), '\.pdf$', '') ELSE source END), '[^a-z0-9_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') || '-' || strftime(make_timestamp(run_id::BIGINT * 1000003), '%Y%m%dT%H%M%SZ') AS id, CASE WHEN run_id % 5 = 0 THEN 'ok' ELSE 'unknown' END AS fallback FROM failures""",
    "pipeline_selection": _with("set_ups") + ", r AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE pages_total END AS n FROM set_ups) SELECT doc_id, profile, CASE WHEN n = pages_total THEN 'full_document' ELSE 'explicit_partial' END AS selection, '[' || (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM range(1, n + 1) t(i)) || ']' AS processed, provider_configured::VARCHAR AS enabled, profile AS detected FROM r",
    "caption_prompts": f"WITH t AS (SELECT p_partkey, p_name, {_PROMPT_SQL.format(**_FILL)} AS prompt FROM part) SELECT p_partkey, sha256(prompt) AS prompt_sha256, sha256(p_partkey || 'image' || prompt || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END) AS input_sha256 FROM t",
    "context_texts": _with("spoken") + """, t AS (SELECT *, CASE WHEN idx % 7 <> 0 THEN text END AS said FROM spoken), n AS (SELECT a.doc_id, a.idx AS tgt, b.idx, '[' || b.element_id || '] ' || b.said AS line FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx % 2 = b.idx % 2 AND a.idx <> b.idx WHERE a.idx % 3 = 0 AND b.said IS NOT NULL),
r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, tgt ORDER BY abs(idx - tgt), idx) <= 6), c AS (SELECT doc_id, tgt, string_agg(line, chr(10) ORDER BY idx) AS context FROM r GROUP BY ALL) SELECT t.doc_id, t.idx, coalesce(c.context, '') AS context FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.idx = c.tgt WHERE t.idx % 3 = 0""",
    "figure_sections": _with("spoken") + r""", b AS (SELECT *, count(*) FILTER (type IN ('title', 'image', 'table')) OVER w AS b FROM spoken WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx ROWS UNBOUNDED PRECEDING)), u AS (SELECT *, max(CASE WHEN type = 'title' THEN b END) OVER (PARTITION BY doc_id, page ORDER BY idx ROWS UNBOUNDED PRECEDING) AS t FROM b),
s AS (SELECT * FROM u WHERE b = t AND type IN ('title', 'text')), g AS (SELECT doc_id, idx, page, ((idx + 2) % 3)::VARCHAR AS figure FROM spoken WHERE type = 'image'), h AS (SELECT DISTINCT g.doc_id, g.idx AS tgt, g.page, g.figure, s.b FROM g JOIN s ON g.doc_id = s.doc_id AND g.page = s.page AND regexp_matches(s.text, '(?i)\bfig\.?\s*' || g.figure || '\b')),
m AS (SELECT h.doc_id, h.tgt, h.figure, s.idx, s.element_id, s.type, s.text, row_number() OVER (PARTITION BY h.doc_id, h.tgt ORDER BY s.idx) AS r FROM h JOIN s ON h.doc_id = s.doc_id AND h.page = s.page AND h.b = s.b)
SELECT doc_id, tgt AS idx, string_agg(CASE WHEN type = 'title' THEN text END, '|' ORDER BY m.idx) AS titles, string_agg(CASE WHEN r <= 6 THEN '[' || element_id || '] ' || text END, chr(10) ORDER BY m.idx) AS context FROM m GROUP BY doc_id, tgt""",
    "check_families": _with("named_checks") + f", g AS (SELECT doc_id, {_RANKS} AS k, count(*) AS checks, count(*) FILTER (NOT passed) AS failed FROM named_checks GROUP BY ALL) SELECT doc_id, ['family.files', 'family.structure', 'family.content', 'family.status', 'family.other'][k + 1] AS family, checks, failed, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN failed > 0 THEN 0 ELSE 1 END, k)::INT AS place FROM g",
    "first_failed": _with("named_checks") + " SELECT * FROM named_checks WHERE NOT passed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 3",
    "type_counts": _with("nodes") + " SELECT doc_id, count(*) FILTER (type = 'chapter') AS chapter, count(*) FILTER (type = 'image') AS image, count(*) FILTER (type = 'text') AS text FROM nodes GROUP BY doc_id",
    "record_labels": _with("nodes") + " SELECT node_id, CASE WHEN type = 'chapter' THEN title ELSE coalesce(caption_original, nullif(substr(text, 1, 64), ''), type || ' · ' || page) END AS label FROM nodes",
    "node_neighbours": _with("nodes") + " SELECT doc_id, ord, node_id, page, lag(node_id) OVER w AS previous, lead(node_id) OVER w AS following, lag(page) OVER w AS previous_page, lead(page) OVER w AS following_page FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY ord)",
    "tree_lines": _with("nodes") + """, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS t FROM nodes WHERE parent IS NULL QUALIFY t <= 3), top2 AS (SELECT *, t = max(t) OVER (PARTITION BY doc_id) AS last FROM top),
kids AS (SELECT n.*, p.t, p.last, row_number() OVER (PARTITION BY n.doc_id, n.parent ORDER BY n.ord) AS c FROM nodes n JOIN top2 p ON n.doc_id = p.doc_id AND n.parent = p.node_id AND p.type = 'chapter' WHERE n.type <> 'chapter' QUALIFY c <= 2), kids2 AS (SELECT *, c = max(c) OVER (PARTITION BY doc_id, parent) AS ends FROM kids),
u AS (SELECT doc_id, t, 0 AS c, CASE WHEN last THEN '└─ ' ELSE '├─ ' END AS prefix, CASE WHEN type = 'chapter' THEN title ELSE coalesce(text, caption_original, type) END AS text, page FROM top2 UNION ALL SELECT doc_id, t, c, CASE WHEN last THEN '   ' ELSE '│  ' END || CASE WHEN ends THEN '└─ ' ELSE '├─ ' END, coalesce(caption_original, text, type), page FROM kids2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t, c)::INT AS line, prefix, text, page FROM u QUALIFY line <= 7""",
    "safe_addresses": _with("addresses") + f", s AS (SELECT *, id % 8 IN (0, 6) AS safe FROM addresses) SELECT id, safe, CASE WHEN safe AND page >= 1 THEN regexp_replace(path, '/+$', '') || '/pages/page_' || {_FOUR.format('page')} || '.png' END AS raster FROM s",
    "shown_tables": _with("pipe_tables") + " SELECT id, CASE WHEN id % 3 <> 2 AND id % 5 <> 0 THEN 3 END AS n_rows, CASE WHEN id % 3 <> 2 AND id % 5 <> 0 THEN trim(split_part(markdown, '| ', 4)) END AS x, NULL AS y FROM pipe_tables",
    "description_fields": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'a=b: ' || p_name || '; c =' || p_size END AS fields FROM part",
    "rebuilt_commands": """SELECT c_custkey, 'docgrid ingest ' || CASE WHEN c_custkey % 2 = 0 THEN '''in/' || c_name || '''\\''''s.pdf''' WHEN regexp_full_match(c_name, '[A-Za-z0-9_./-]+') THEN 'in/' || c_name || '.pdf' ELSE '''in/' || c_name || '.pdf''' END || ' --out run-' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN ' --pages 1-3,5' ELSE '' END
 || CASE WHEN c_custkey % 5 = 0 THEN ' --page-previews' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN ' --no-enrich' ELSE '' END AS command FROM customer""",
    "run_contradictions": _with("results") + " " + _rules("results", {"manual_id": "run_id <> manual_id", "source": "source_file IS NULL", "detected": "profile <> detected_profile", "report_id": "doc_id % 2 = 0 AND manual_id <> run_id", "not_passed": "doc_id % 3 = 0 AND (doc_id % 2 <> 0 OR doc_id % 6 = 0)"}),
    "bundle_agreement": _with("results") + ", r AS (SELECT *, CASE WHEN doc_id % 37 = 0 THEN 'a/b' ELSE run_id END AS id FROM results) " + _rules("r", {"manual_id": "id <> manual_id", "report_id": "id <> run_id", "status": "doc_id % 3 = 0 AND doc_id % 6 = 0", "unsafe_id": "doc_id % 37 = 0"}),
}
ORACLE_SQL["shown_tables"] = _with("pipe_tables") + r" SELECT id, CASE WHEN id % 3 <> 2 AND id % 5 <> 0 THEN 3 END AS n_rows, CASE WHEN id % 3 <> 2 AND id % 5 <> 0 THEN regexp_extract(markdown, '\| ([^|]*) \| a\\\|b \|', 1) || ';a|b' END AS third FROM pipe_tables"

ORACLE_SQL["caption_parameters"] = _with("visuals", "set_ups") + " SELECT doc_id, element_id AS id, 'num_ctx' AS error FROM visuals JOIN set_ups USING (doc_id) WHERE provider IS NOT NULL AND element_id % 29 = 0"
ORACLE_SQL["enrichment_evidence"] = _with("visuals", "enriched", "set_ups") + """, f AS (SELECT DISTINCT doc_id FROM enriched WHERE status = 'failed' AND element_id % 3 = 0), l AS (SELECT DISTINCT doc_id FROM visuals WHERE type = 'image' AND exclusion_reason = 'caption provider unavailable in diagnostic run'),
r AS (SELECT doc_id, CASE WHEN NOT provider_configured THEN 'not_configured' WHEN doc_id % 17 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'set_up' WHEN doc_id IN (SELECT doc_id FROM f) THEN 'failed' WHEN doc_id IN (SELECT doc_id FROM l) THEN 'left_out' END AS reason FROM set_ups) SELECT doc_id, reason IS NULL AS passed, reason FROM r"""


def _as_relation(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


_EVIDENCE = " UNION ALL ".join(f"SELECT doc_id FROM {_as_relation(n)}" for n in ("enrichment_items", "pipeline_transitions", "trace_exclusions"))
_ERRORS = {
    "run_id.coherent": f"SELECT doc_id FROM {_as_relation('source_agreement')} WHERE error = 'run_id'", "source.coherent": f"SELECT doc_id FROM {_as_relation('source_agreement')} WHERE error <> 'run_id'", "captions.provenance.consistent": f"SELECT doc_id FROM {_as_relation('caption_consistency')}",
    "captions.provenance.identity": f"SELECT doc_id FROM {_as_relation('caption_identity')}", "promotion.evidence.coherent": _EVIDENCE, "validation.artifact": f"SELECT doc_id FROM {_as_relation('report_compare')}", "pages.content": f"SELECT doc_id FROM {_as_relation('page_set')}",
}
ORACLE_SQL["report_checks"] = "WITH every AS (SELECT CAST(c_custkey AS INT) AS doc_id, unnest([" + ", ".join(f"'{n}'" for n in _ERRORS) + "]) AS check_id FROM customer), found AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS check_id FROM ({q})" for n, q in _ERRORS.items()) + ") SELECT e.doc_id, e.check_id, count(f.doc_id) = 0 AS passed, count(f.doc_id) AS errors FROM every e LEFT JOIN found f ON e.doc_id = f.doc_id AND e.check_id = f.check_id GROUP BY ALL"


def _reasons_sql() -> str:
    from docgrid.operators import detect
    from docgrid.plans.queries import ORACLE_SQL as base

    return f"""WITH p AS ({base["detect_profile"]}), q AS (SELECT p.*, regexp_extract(d.source, '[0-9]+')::INT % 2 = 0 AS has, greatest(1, ceil(sampled * 0.75))::INT AS need FROM p JOIN documents d USING (doc_id)),
s AS (SELECT *, with_text || '/' || sampled || ' sampled pages (' || printf('%.1f', with_text / sampled * 100) || '%) contain at least 40 non-whitespace characters (minimum required: ' || need || '/' || sampled || ' under the 75% digital-coverage policy).' AS policy FROM q)
SELECT doc_id, CASE WHEN has THEN 'Embedded PDF outline detected (3 entries).' ELSE 'No embedded PDF outline detected.' END || '|' || CASE WHEN text_layer THEN 'Robust text-layer coverage detected: ' ELSE 'Insufficient text-layer coverage for a digital profile: ' END || policy || '|Median sampled text count: ' || printf('%.1f', median_chars) || ' non-whitespace characters.|'
 || CASE WHEN profile = 'digital_outline' THEN '{detect.SELECTED[1]}' WHEN profile = 'digital_reconstructed' THEN '{detect.SELECTED[3]}' WHEN with_text > 0 THEN 'Selected scanned_ocr fail closed because usable text appears on only ' || with_text || '/' || sampled || ' sampled pages, below the required ' || need || '/' || sampled || ' digital coverage.' || CASE WHEN has THEN '{detect.CLAUSE}' ELSE '' END
  WHEN has THEN '{detect.OUTLINE_ALONE}' ELSE '{detect.NEITHER}' END AS reasons FROM s"""


ORACLE_SQL["profile_reasons"] = _reasons_sql()


def _from_others() -> dict[str, str]:
    from docgrid.plans.queries import ORACLE_SQL as base
    from docgrid.plans.structure_queries import ORACLE_SQL as structure

    return {
        "profile_routing": f"SELECT doc_id, profile AS plan, CASE WHEN doc_id % 3 = 0 THEN 'asked' ELSE 'doc.' || doc_id END AS title FROM ({base['detect_profile']})",
        "status_promotion": f"WITH g AS ({structure['promotion_gates']}) SELECT doc_id, string_agg(gate_id, ',' ORDER BY gate_no) AS failed FROM g WHERE doc_id % 2 = 0 AND NOT coalesce(passed, false) GROUP BY doc_id",
    }


ORACLE_SQL |= _from_others()
