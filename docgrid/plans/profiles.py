"""The three profiles from their relations to assembled documents, and the plan that routes among them.

Every plan gives (chapters, elements, entries, warnings, failed); ``failed`` is (doc_id, stage) of the
documents that have no outline or break a guard, which the other four leave out. Outlines and elements
are staged before they are assembled, as each is used by several parts of the plan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators import assembly, blocks, printed, scanned
from docgrid.sources.staging import staged


class Assembled(NamedTuple):
    chapters: DataFrame
    elements: DataFrame
    entries: DataFrame
    warnings: DataFrame
    failed: DataFrame


def _assembled(entries: DataFrame, totals: DataFrame, elements: DataFrame, failed: DataFrame) -> Assembled:
    runs = totals.select("doc_id", "pages_total", F.sequence(F.lit(1), F.col("pages_total")).alias("pages"))
    bad = assembly.outline_errors(entries, runs).select("doc_id", F.lit("outline").alias("stage")).unionByName(assembly.element_errors(elements, runs).select("doc_id", F.lit("element").alias("stage")))
    bad = bad.unionByName(totals.select("doc_id").join(entries.select("doc_id"), "doc_id", "left_anti").join(failed.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("no_outline").alias("stage")))
    failed = staged(failed.unionByName(bad.distinct()))
    good = lambda d: staged(d.join(failed.select("doc_id").distinct(), "doc_id", "left_anti"))
    entries = good(entries)
    chapters, placed, warnings = assembly.assemble(entries, totals, good(elements))
    return Assembled(chapters, placed, entries, warnings, failed)


def _none(like: DataFrame) -> DataFrame:
    return like.select("doc_id", F.lit("").alias("stage")).limit(0)


def digital_outline(toc: DataFrame, totals: DataFrame, elements: DataFrame) -> Assembled:
    """Documents with bookmarks: ``toc`` (doc_id, ord, level, title, page), ``totals`` (doc_id, pages_total)."""
    return _assembled(toc, totals, elements, _none(totals))


def digital_reconstructed(lines: DataFrame, labels: DataFrame, totals: DataFrame, elements: DataFrame) -> Assembled:
    """Documents with text and a printed index: the outline comes from their lines."""
    entries, failed = printed.reconstruct_outline(lines, labels, totals)
    return _assembled(staged(entries), totals, elements, staged(failed))


def scanned_ocr(raw: DataFrame, totals: DataFrame, embedded: DataFrame | None = None) -> Assembled:
    """Recognised documents: bookmarks ``embedded`` where a document has them, else an index or titles of its elements.

    Elements of index pages go to the root and out of retrieval.
    """
    e = staged(blocks.page_elements(raw))
    wrong = e.filter("error is not null").select("doc_id", F.concat(F.lit("block_"), "error").alias("stage")).distinct()
    e = e.filter("error is null").withColumns({"ord": F.col("reading_order"), "y0": F.col("bbox.y0"), "table_markdown": F.when(F.col("type") == "table", F.col("text")), "include_in_rag": F.lit(True), "exclusion_reason": F.lit(None).cast("string")})
    own = totals if embedded is None else totals.join(embedded.select("doc_id").distinct(), "doc_id", "left_anti")
    read = e.join(own.select("doc_id"), "doc_id", "left_semi")
    read = staged(read)
    entries, _, failed = scanned.reconstruct_outline(read, own)
    entries, failed = staged(entries.select("doc_id", "ord", "level", "title", "page")), staged(failed)
    if embedded is not None:
        entries = entries.unionByName(embedded.select("doc_id", "ord", "level", "title", "page"))
    out = _assembled(entries, totals, e, failed.unionByName(wrong))
    placed = scanned.ordered(read)
    pages = scanned.index_pages(placed, scanned.raw_rows(placed)).join(own.select("doc_id"), "doc_id", "left_semi")
    elements = assembly.detach_index(out.elements.withColumn("parent", F.col("chapter_ord")), pages).drop("chapter_ord").withColumnRenamed("parent", "chapter_ord")
    return out._replace(elements=elements)
