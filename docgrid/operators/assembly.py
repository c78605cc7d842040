"""From an outline and elements to a document: routing, anchors inside a page, order of content, guards.

Relations lead with doc_id. An error of one document is a row, never an exception for all.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.functions.unicode import nfkc
from docgrid.operators import outline, tree
from docgrid.sources.staging import staged

#: Profiles, the least score of an anchor and its distance from the next, titles of one span, the mark of index pages.
PROFILES = ("digital_outline", "digital_reconstructed", "scanned_ocr")
SCORE, MARGIN, SPAN = 0.90, 0.04, 2
INDEX_PAGE = "printed table-of-contents source page"
SECTION = rf"^(\d+(?:\.\d+)*)(?![{T.WORD}])"


def route(selection: DataFrame, plans: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The union of each profile's plan over its own documents of ``selection`` (doc_id, profile, ...); others have no plan."""
    if set(plans) - set(PROFILES):
        raise ValueError(f"unknown profiles: {sorted(set(plans) - set(PROFILES))}")
    out = [plan(selection.filter(F.col("profile") == name)) for name, plan in plans.items()]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def unrouted(selection: DataFrame) -> DataFrame:
    """(doc_id, profile) of documents without a known profile: there is no default."""
    return selection.filter(~F.coalesce(F.col("profile").isin(*PROFILES), F.lit(False))).select("doc_id", "profile")


def resolved_title(explicit: Column, metadata: Column, source: Column) -> Column:
    """The first title that is not blank: asked for, of the file, or the name of the file without its ending."""
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(*(F.nullif(T.squeeze_ends(c), F.lit("")) for c in (explicit, metadata, stem)))


def chapter_id(index: Column, title: Column) -> Column:
    """The id of the entry at ``index`` from 0: its number in four digits and a name of at most 48 characters."""
    number = (index + 1).cast("string")
    slug = F.substring(F.regexp_replace(F.regexp_replace(T.fold(title), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)
    return F.concat(F.lit("chapter-"), F.when(F.length(number) > 4, number).otherwise(F.lpad(number, 4, "0")), F.when(slug == "", "").otherwise(F.concat(F.lit("-"), slug)))


def section_number(title: Column) -> Column:
    """The number that a title begins with, or null."""
    return F.nullif(F.regexp_extract(T.squeeze_ends(title), SECTION, 1), F.lit(""))


# --- anchors ---------------------------------------------------------------------------------


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _near(wanted: str, number: str | None, titles: list[dict], used: set[int]) -> tuple[list[int], float, str] | None:
    """The span of unused titles that is clearly the most like ``wanted``, else the only one with its number."""
    starts: dict[int, tuple[float, list[int]]] = {}
    for at in range(len(titles)):
        for n in range(1, SPAN + 1):
            span = list(range(at, at + n))
            if span[-1] < len(titles) and not used.intersection(span):
                score = _ratio(wanted, " ".join(filter(None, (titles[k]["norm"] for k in span))))
                order = titles[at]["reading_order"]
                if order not in starts or score > starts[order][0]:
                    starts[order] = score, span
    ranked = sorted(starts.values(), key=lambda x: -x[0])
    if ranked and ranked[0][0] >= SCORE and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0.0) >= MARGIN:
        return ranked[0][1], ranked[0][0], "similar"
    same = [k for k, t in enumerate(titles) if number and k not in used and t["number"] == number]
    return (same, _ratio(wanted, titles[same[0]]["norm"]), "number") if len(same) == 1 else None


def _anchored(page: pd.DataFrame) -> pd.DataFrame:
    """The chapters and titles of one page on which two or more chapters start."""
    page = page.astype(object).where(page.notna(), None)
    chapters = page[page["kind"] == "c"].sort_values("at").to_dict("records")
    titles = page[page["kind"] == "t"].sort_values(["at", "id"]).rename(columns={"at": "reading_order"}).to_dict("records")
    if not chapters:
        return pd.DataFrame(columns=["doc_id", "page", "ord", "anchor", "outcome", "score"])
    entries = Counter(c["norm"] for c in chapters)
    by_name: dict[str, list[int]] = {}
    for k, t in enumerate(titles):
        by_name.setdefault(t["norm"], []).append(k)
    found, used = {}, set()
    for i, c in enumerate(chapters):
        same = by_name.get(c["norm"], [])
        if len(same) == 1 and entries[c["norm"]] == 1:
            found[i] = titles[same[0]]["reading_order"], "exact", 1.0
            used.add(same[0])
        elif same:
            found[i] = None, "ambiguous", None
    open_ = [i for i in range(len(chapters)) if i not in found]
    for i in open_:
        near = _near(chapters[i]["norm"], chapters[i]["number"], titles, used)
        if near:
            found[i] = titles[near[0][0]]["reading_order"], near[2], near[1]
            used.update(near[0])
        else:
            # what lies below an open chapter may have boundaries of its own
            below = [j for j, c in enumerate(chapters) if c["parent"] == chapters[i]["at"]]
            found[i] = None, "delegated" if any(found.get(j, (None,))[0] is not None for j in below) else "unmatched", None
    taken = Counter(a for a, _, _ in found.values() if a is not None)
    rows = []
    for i, c in enumerate(chapters):
        anchor, outcome, score = found[i]
        if anchor is not None and taken[anchor] > 1:
            anchor, outcome = None, "shared"
        rows.append((c["doc_id"], c["page"], c["at"], anchor, outcome, score))
    return pd.DataFrame(rows, columns=["doc_id", "page", "ord", "anchor", "outcome", "score"])


def page_anchors(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, page, ord, anchor, outcome, score) of the chapters that share the page on which they start.

    ``chapters`` is (doc_id, ord, parent_ord, title, page), ``titles`` (doc_id, page, element_id,
    reading_order, text). Equal folded titles come first, where one chapter meets one title; those
    left meet spans of up to two titles by likeness, in the order of the outline, as each takes its
    titles away from the next. A task holds one page; pages where a single chapter starts need none.
    """
    kind = chapters.schema["doc_id"].dataType.simpleString()
    shared = chapters.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id", "page")
    norm = lambda c: T.fold_title(nfkc(F.coalesce(F.col(c), F.lit(""))))
    c = chapters.join(shared, ["doc_id", "page"]).select("doc_id", "page", F.lit("c").alias("kind"), F.col("ord").cast("long").alias("at"), F.col("parent_ord").cast("long").alias("parent"), F.lit("").alias("id"), norm("title").alias("norm"), section_number(nfkc(F.col("title"))).alias("number"))
    t = titles.filter(F.col("reading_order").isNotNull()).join(shared, ["doc_id", "page"], "left_semi")
    t = t.select("doc_id", "page", F.lit("t").alias("kind"), F.col("reading_order").cast("long").alias("at"), F.lit(None).cast("long").alias("parent"), F.col("element_id").cast("string").alias("id"), norm("text").alias("norm"), section_number(nfkc(F.coalesce("text", F.lit("")))).alias("number"))
    schema = f"doc_id {kind}, page int, ord long, anchor long, outcome string, score double"
    return c.unionByName(t).withColumn("page", F.col("page").cast("int")).groupBy("doc_id", "page").applyInPandas(_anchored, schema)


def disordered_pages(anchors: DataFrame) -> DataFrame:
    """(doc_id, page) where the anchors of (doc_id, page, ord, anchor) do not rise with the outline."""
    order = W.partitionBy("doc_id", "page").orderBy("ord")
    back = anchors.filter("anchor is not null").withColumn("_back", F.col("anchor") < F.lag("anchor").over(order))
    return back.filter("_back").select("doc_id", "page").distinct()


# --- content ---------------------------------------------------------------------------------


def content_order(items: DataFrame) -> DataFrame:
    """``items`` (doc_id, parent, ord, kind, page, at) with their position inside the parent, from 0.

    ``at`` is a chapter's anchor or an element's reading order. On a page a chapter's anchor never
    goes back behind that of an earlier chapter, so the outline's order holds; before equal elements
    a chapter comes first. All that is equal keeps its order.
    """
    sibling = W.partitionBy("doc_id", "parent", "kind", "page").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    chapter = F.col("kind") == "chapter"
    place = F.when(chapter, F.max(F.coalesce("at", F.lit(-1))).over(sibling)).otherwise(F.coalesce("at", F.lit(0)))
    items = items.withColumn("_place", place)
    order = W.partitionBy("doc_id", "parent").orderBy("page", "_place", F.when(chapter, 0).otherwise(1), "ord")
    return items.withColumn("position", F.row_number().over(order) - 1).drop("_place")


def detach_index(elements: DataFrame, index_pages: DataFrame) -> DataFrame:
    """Elements of (doc_id, page) index pages go to the root and out of retrieval; all others stay as they are."""
    on = elements.join(index_pages.select("doc_id", "page").distinct().withColumn("_x", F.lit(True)), ["doc_id", "page"], "left")
    x = F.col("_x").isNotNull()
    changed = {"parent": F.when(~x, F.col("parent")), "include_in_rag": F.when(x, F.lit(False)).otherwise(F.col("include_in_rag")), "exclusion_reason": F.when(x, INDEX_PAGE).otherwise(F.col("exclusion_reason"))}
    return on.withColumns(changed).drop("_x")


def root_order(items: DataFrame) -> DataFrame:
    """The position of root items (doc_id, ord, kind, page, at): by page, chapters before elements, these by reading order."""
    order = W.partitionBy("doc_id").orderBy("page", F.when(F.col("kind") == "chapter", 0).otherwise(1), F.when(F.col("kind") == "chapter", 0).otherwise(F.coalesce("at", F.lit(0))), "ord")
    return items.withColumn("position", F.row_number().over(order) - 1)


def assemble(toc: DataFrame, totals: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chapters, elements, warnings) of a document with an outline.

    ``toc`` is (doc_id, ord, level, title, page), ``elements`` (doc_id, element_id, ord, type, page,
    text, reading_order). Chapters get their id, parent, last page and anchor; elements the
    chapter they belong to and their position in it; what precedes the first chapter stays at the root.
    """
    chapters = outline.chapters(toc, totals).withColumn("chapter_id", chapter_id(F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1, F.col("title")))
    elements = elements.withColumn("reading_order", F.coalesce("reading_order", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1))
    titles = elements.filter("type = 'title'").select("doc_id", "page", "element_id", "reading_order", "text")
    chapters = staged(chapters)
    anchors = staged(page_anchors(chapters, titles))
    anchored = chapters.join(anchors.select("doc_id", "ord", "anchor", F.lit(True).alias("shared")), ["doc_id", "ord"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    homes = tree.chapter_at(elements.select("doc_id", "element_id", "page", "reading_order"), anchored).select("doc_id", "element_id", "chapter_ord")
    placed = staged(elements.join(homes, ["doc_id", "element_id"]))
    items = anchored.select("doc_id", F.col("parent_ord").alias("parent"), F.col("ord").cast("long").alias("ord"), F.lit("chapter").alias("kind"), "page", F.col("anchor").alias("at"), F.col("chapter_id").alias("id"))
    items = items.unionByName(placed.select("doc_id", F.col("chapter_ord").alias("parent"), F.col("ord").cast("long").alias("ord"), F.lit("element").alias("kind"), "page", F.col("reading_order").cast("long").alias("at"), F.col("element_id").cast("string").alias("id")))
    order = content_order(items).select("doc_id", "kind", "id", "position")
    loose = placed.filter("chapter_ord is null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    warnings = loose.select("doc_id", F.concat(F.col("n").cast("string"), F.lit(" element(s) precede the first outline destination and remain at document root")).alias("warning"))
    warnings = warnings.unionByName(anchors.filter("outcome <> 'exact'").select("doc_id", F.concat(F.lit("outline anchor "), "outcome", F.lit(": page "), F.col("page").cast("string")).alias("warning")))
    chapters = anchored.join(order.filter("kind = 'chapter'").select("doc_id", F.col("id").alias("chapter_id"), "position"), ["doc_id", "chapter_id"])
    at = order.filter("kind = 'element'").select("doc_id", F.col("id").alias("_id"), "position")
    placed = placed.withColumn("_id", F.col("element_id").cast("string")).join(at, ["doc_id", "_id"]).drop("_id")
    return chapters, placed, warnings


# --- guards ----------------------------------------------------------------------------------


def element_errors(elements: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, element_id, error): ids that repeat, and pages that were not asked for or are not in the document.

    ``runs`` is (doc_id, pages_total, pages array).
    """
    e = elements.join(runs, "doc_id")
    again = elements.groupBy("doc_id", "element_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id", "element_id", F.lit("duplicate_id").alias("error"))
    outside = e.filter((F.col("page") > F.col("pages_total")) | ~F.array_contains("pages", F.col("page"))).select("doc_id", "element_id", F.lit("page").alias("error")).distinct()
    return again.unionByName(outside)


def outline_errors(toc: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, ord, page) of entries that point behind the last page."""
    return toc.join(runs.select("doc_id", "pages_total"), "doc_id").filter("page > pages_total").select("doc_id", "ord", "page")


#: What a finished profile must agree with, in order: name, column of the result, column of what was asked.
GUARDS = (("id", "manual_id", "run_id"), ("source", "source_file", "source_name"), ("language", "language", "asked_language"), ("pages_total", "pages_total", "inspected_pages"), ("pages", "pages_processed", "asked_pages"), ("profile", "profile", "detected_profile"))


def result_errors(results: DataFrame) -> DataFrame:
    """(doc_id, guard) of each agreement that a profile's result breaks.

    ``results`` has the columns of ``GUARDS``, title, asked_title (null: none), toc_available,
    toc_entries, parser, strategy and warnings.
    """
    rules = [(name, F.col(a).eqNullSafe(F.col(b))) for name, a, b in GUARDS]
    rules += [
        ("title", F.col("asked_title").isNull() | F.col("title").eqNullSafe(T.squeeze_ends(F.col("asked_title")))), ("toc", F.col("toc_available").eqNullSafe(F.col("toc_entries") > 0)),
        ("set_up", (T.squeeze_ends(F.col("parser")) != "") & (T.squeeze_ends(F.col("strategy")) != "")), ("warnings", F.forall("warnings", lambda w: F.coalesce(T.squeeze_ends(w) != "", F.lit(False)))),
    ]
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)), lambda x: x.isNotNull())
    return results.select("doc_id", F.explode(broken).alias("guard"))


def page_selection(asked: DataFrame) -> DataFrame:
    """(doc_id, pages, error) of (doc_id, asked array or null, pages_total): sorted pages, all of them where none are asked for."""
    low, high, a = F.array_min("asked"), F.array_max("asked"), F.col("asked")
    error = F.when(F.size(a) == 0, "empty").when(F.size(F.array_distinct(a)) < F.size(a), "repeated").when((low < 1) | (high > F.col("pages_total")), "outside")
    pages = F.when(a.isNull(), F.sequence(F.lit(1), F.col("pages_total"))).otherwise(F.array_sort(a))
    return asked.select("doc_id", F.when(a.isNull() | error.isNull(), pages).alias("pages"), F.when(a.isNotNull(), error).alias("error"))
