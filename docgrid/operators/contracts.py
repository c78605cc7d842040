"""Contracts of records as rows of broken rules: elements, serialized tables, outlines, manifests.

Each rule is a column that is true where it is kept; null counts as broken. A record without broken
rules keeps its contract. JSON texts are judged by the same rules after ``from_json``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions import text as T

#: Kinds of elements, states of tables and of runs.
TYPES, TABLES = ("title", "text", "image", "table"), ("structured", "fallback", "unavailable")
FINISHED, STATES = ("validated", "experimental"), ("running", "failed", "validated", "experimental")
ARTIFACTS = ("manual", "toc", "validation", "assets", "diagnostics")


def broken(rows: DataFrame, keys: tuple[str, ...], rules: Mapping[str, Column]) -> DataFrame:
    """(keys, error): a row for each rule that a record breaks."""
    found = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(found).alias("error"))


def _has(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def trimmed(c: Column) -> Column:
    """Whether a text is there and has no white space at its ends."""
    return (c != "") & (T.squeeze_ends(c) == c)


def digest(c: Column) -> Column:
    return F.lower(c).rlike("^[0-9a-f]{64}$")


def element_errors(elements: DataFrame) -> DataFrame:
    """Elements (doc_id, element_id, type, page, source_page, page_width, page_height, x0, y0, x1, y1, text, image_path,
    table_image_path, table_markdown, caption, provider, input_sha256, reading_order, heading_level, include_in_rag,
    exclusion_reason, continued, continuation_group, table_status) against their contract."""
    kind = F.col("type")
    sized, boxed = F.col("page_width").isNotNull(), F.col("x0").isNotNull()
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= F.col("page_width")) & (F.col("y1") <= F.col("page_height"))
    rules = {
        "type": kind.isin(*TYPES), "page": F.col("page") >= 1, "source_page": F.col("page") == F.col("source_page"), "page_size": ~sized | ((F.col("page_width") > 0) & (F.col("page_height") > 0)),
        "bbox": ~boxed | ((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))), "bbox_inside": ~boxed | ~sized | inside, "text": ~kind.isin("title", "text") | _has("text"),
        "image_path": (kind != "image") | _has("image_path"), "image_table": (kind != "image") | ~(_has("table_image_path") | _has("table_markdown") | F.col("table_status").isNotNull()), "table_source": (kind != "table") | _has("table_image_path") | _has("table_markdown"), "table_image": (kind != "table") | ~_has("image_path"),
        "serialization": F.col("table_status").isNull() | ((kind == "table") & F.col("table_status").isin(*TABLES)), "caption": ~_has("caption") | kind.isin("image", "table"), "provenance": F.col("provider").isNull() | (_has("caption") & trimmed(F.col("provider")) & digest(F.col("input_sha256"))),
        "reading_order": F.col("reading_order").isNull() | (F.col("reading_order") >= 0), "heading_level": F.col("heading_level").isNull() | (F.col("heading_level") >= 1), "exclusion": F.col("include_in_rag") != _has("exclusion_reason"), "continued": ~F.col("continued") | _has("continuation_group"),
    }
    return broken(elements, ("doc_id", "element_id"), rules)


def table_errors(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Serialized tables (doc_id, element_id, status) with their rows (doc_id, element_id, row_index, row_id, serialized_text)."""
    r = rows.groupBy("doc_id", "element_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("row_index").alias("_a"), F.max("row_index").alias("_b"), F.count_distinct("row_index").alias("_i"), F.count_distinct("row_id").alias("_ids"), F.count_if(~F.coalesce(trimmed(F.col("row_id")) & trimmed(F.col("serialized_text")), F.lit(False))).alias("_blank"),
    )
    t = tables.join(r, ["doc_id", "element_id"], "left").na.fill(0, ["_n", "_i", "_ids", "_blank"])
    n, status = F.col("_n"), F.col("status")
    rules = {
        "status": status.isin(*TABLES), "indexes": (n == 0) | ((F.col("_a") == 1) & (F.col("_b") == n) & (F.col("_i") == n)), "ids": F.col("_ids") == n, "blank": F.col("_blank") == 0,
        "structured": (status != "structured") | (n > 0), "fallback": (status != "fallback") | (n == 1), "unavailable": (status != "unavailable") | (n == 0),
    }
    return broken(t, ("doc_id", "element_id"), rules)


def outline_errors(toc: DataFrame) -> DataFrame:
    """Entries (doc_id, ord, level, title, page, confidence) against their contract."""
    rules = {"level": F.col("level") >= 1, "title": T.squeeze_ends(F.col("title")) != "", "page": F.col("page") >= 1, "confidence": F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0)}
    return broken(toc, ("doc_id", "ord"), rules)


def detection_errors(runs: DataFrame) -> DataFrame:
    """What was detected (doc_id, profile, has_outline, text_layer, confidence, pages_total, sampled_pages array, pages_with_text)."""
    profile, outline, text = F.col("profile"), F.col("has_outline"), F.col("text_layer")
    rules = {
        "profile": F.when(outline & text, profile == "digital_outline").when(text, profile == "digital_reconstructed").otherwise(profile == "scanned_ocr"), "confidence": F.col("confidence").between(0.0, 1.0), "sampled": F.size("sampled_pages") > 0,
        "bounds": F.forall("sampled_pages", lambda p: (p >= 1) & (p <= F.col("pages_total"))), "distinct": F.size(F.array_distinct("sampled_pages")) == F.size("sampled_pages"), "with_text": F.col("pages_with_text").between(0, F.size("sampled_pages")),
    }
    return broken(runs, ("doc_id",), rules)


def manifest_errors(runs: DataFrame) -> DataFrame:
    """Manifests (doc_id, run_id, status, started_at, completed_at, warnings, errors arrays, profile, detected_profile, provider, model, source_sha256, and a path a name of ``ARTIFACTS``)."""
    status = F.col("status")
    paths = [F.lit("run.json"), *(F.col(n) for n in ARTIFACTS)]
    parts = F.filter(F.array(*(F.when(p.isNotNull(), T.path_parts(p)) for p in paths)), lambda p: p.isNotNull())
    meet = lambda a, b: F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))) == F.slice(b, F.lit(1), F.least(F.size(a), F.size(b)))
    apart = ~F.exists(F.transform(parts, lambda a, i: F.exists(F.slice(parts, i + 2, F.size(parts)), lambda b: meet(a, b))), lambda x: x)
    done = F.col("completed_at").isNotNull()
    rules = {
        "run_id": T.safe_component(F.col("run_id")), "status": status.isin(*STATES), "digest": digest(F.col("source_sha256")), "identity": F.col("provider").isNull() == F.col("model").isNull(), "paths": F.forall(F.filter(F.array(*(F.col(n) for n in ARTIFACTS)), lambda p: p.isNotNull()), T.safe_path), "overlap": apart,
        "completed": F.when(status == "running", ~done).otherwise(done), "order": ~done | (F.col("completed_at") >= F.col("started_at")), "failed": (status != "failed") | (F.size("errors") > 0), "errors": ~status.isin(*FINISHED) | (F.size("errors") == 0), "warned": (status != "experimental") | (F.size("warnings") > 0), "profile": ~status.isin(*FINISHED) | (F.col("profile") == F.col("detected_profile")),
    }
    return broken(runs, ("doc_id",), rules)


def counter_errors(reports: DataFrame, decisions: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Diagnostics (doc_id and a count for each state) against their decisions (doc_id, element_id, status): counts that differ, ids that repeat."""
    counts = decisions.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(f"_{s}") for s in states), (F.count(F.lit(1)) - F.count_distinct("element_id")).alias("_twice"))
    r = reports.join(counts, "doc_id", "left").na.fill(0, [*(f"_{s}" for s in states), "_twice"])
    return broken(r, ("doc_id",), {**{s: F.col(s) == F.col(f"_{s}") for s in states}, "ids": F.col("_twice") == 0})
