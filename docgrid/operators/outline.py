"""Chapters of an outline, the chapter of a page, and orders that keep chapters in place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _enclosed(entries: pd.DataFrame) -> pd.DataFrame:
    """Parent and next boundary of each entry of one document, by a stack of the open ones."""
    entries = entries.sort_values("ord")
    ords, levels, pages = (entries[c].tolist() for c in ("ord", "level", "page"))
    parents: list[int | None] = []
    ends: list[int | None] = [None] * len(ords)
    open_: list[int] = []
    for i, level in enumerate(levels):
        while open_ and levels[open_[-1]] >= level:
            ends[open_.pop()] = pages[i]
        parents.append(ords[open_[-1]] if open_ else None)
        open_.append(i)
    return pd.DataFrame({"doc_id": entries["doc_id"], "ord": ords, "parent_ord": pd.array(parents, "Int64"), "_next": pd.array(ends, "Int64")})


def chapters(toc: DataFrame, pages_total: DataFrame) -> DataFrame:
    """Parent and last page of each entry of (doc_id, ord, level, title, page), at any level.

    The parent is the nearest earlier entry of a lower level; a chapter ends before the next entry
    of its own or a lower level. One pass over a document's outline finds both.
    """
    kinds = {c: toc.schema[c].dataType.simpleString() for c in ("doc_id", "ord", "page")}
    schema = f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, parent_ord {kinds['ord']}, _next {kinds['page']}"
    found = toc.select("doc_id", "ord", "level", "page").groupBy("doc_id").applyInPandas(_enclosed, schema)
    out = toc.join(found, ["doc_id", "ord"]).join(pages_total, "doc_id")
    end = F.when(F.col("_next").isNull(), F.col("pages_total")).otherwise(F.greatest(F.col("page"), F.col("_next") - 1))
    return out.select("doc_id", "ord", "parent_ord", "level", "title", "page", F.least(end, F.col("pages_total")).alias("page_end"))


def page_chapters(chapters: DataFrame, after_start: bool = False) -> DataFrame:
    """(doc_id, page, level, ord): the deepest, then latest chapter of each page; ``after_start``: of those that began on an earlier one.

    A chapter is dealt out over its pages, so the rows are a document's pages times its depth, and
    elements meet them by equality.
    """
    first = F.col("page") + (1 if after_start else 0)
    rows = chapters.filter(first <= F.col("page_end")).select("doc_id", "level", "ord", F.explode(F.sequence(first, F.col("page_end"))).alias("page"))
    return rows.groupBy("doc_id", "page").agg(F.max(F.struct("level", "ord")).alias("_b")).select("doc_id", "page", "_b.level", "_b.ord")


def chapter_of(elements: DataFrame, chapters: DataFrame) -> DataFrame:
    """The deepest, then latest chapter whose pages hold the element's page, or null."""
    best = page_chapters(chapters).withColumnsRenamed({"ord": "chapter_ord", "level": "chapter_level"})
    return elements.select("doc_id", "element_id", "page").join(best, ["doc_id", "page"], "left").select("doc_id", "element_id", "page", "chapter_ord", "chapter_level")


def monotone_anchors(items: DataFrame) -> DataFrame:
    """Anchors of (doc_id, page, ord, anchor) that never go back within a page; -1 before any."""
    w = W.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("effective", F.max(F.coalesce("anchor", F.lit(-1))).over(w))


def roman_depth(rows: DataFrame, max_depth: int = 6) -> DataFrame:
    """Numbered rows of (doc_id, idx, title, level) after a roman section are a level deeper."""
    roman, numbered = F.col("title").rlike(r"^[IVXLCDM]+[.)]? "), F.col("title").rlike(r"^[0-9]+([._-][0-9]+)*( |$)")
    inside = F.max(roman).over(W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    deeper = F.coalesce(inside, F.lit(False)) & ~roman & numbered
    return rows.withColumn("depth", F.when(deeper, F.least(F.col("level") + 1, F.lit(max_depth))).otherwise(F.col("level")))
