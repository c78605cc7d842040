"""Outlines of scanned documents from recognised elements: printed index first, titles else.

Elements are (doc_id, element_id, type, page, reading_order, y0, role, text, table_markdown), type
one of title, text, image, table. Texts are brought to NFKC once, in ``ordered``; what follows is
columns, but for the similarity of titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.functions.unicode import nfkc
from docgrid.operators.printed import similarity
from docgrid.operators.tree import offset_vote

#: Fixed values.
KEYWORDS = ("index", "indice", "contents", "table of contents", "sommario")
VISUAL_ROLES = ("figure_title", "figure_caption", "image_caption", "table_title", "table_caption")
WINDOW, ROWS, TITLE, MATCH, GAIN = 10, 3, 180, 0.72, 0.08
REPEAT_PAGES, REPEAT_SHARE = 3, 0.5
CONFIRMED, BY_TITLE, BY_OFFSET, PRINTED, FALLBACK, RATIO = 0.96, 0.82, 0.84, 0.9, 0.55, 0.8
PAGE_REF = r"(?:[A-Za-z]+-?)?\d{1,4}"
DOT_ROW = rf"^(.+?)\s*\.{{2,}}\s*({PAGE_REF})$"
RULE = r"^:?-{2,}:?$"
ROMAN = r"(?i)^\s*[IVXLCDM]+\.(?:\s+\S|$)"
NUMERIC = rf"^\s*{T.NUMBER}{T._END}"
LETTERED = rf"^\s*[A-Z](?:\.\d+)+{T._END}"
LEADING = rf"(?i)^\s*({T.NUMBER}|[IVXLCDM]+\.)(?=\s|$)"
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def spaced(text: Column) -> Column:
    """Blanks as one space, lines kept, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), f"^{T.SPACE}+|{T.SPACE}+$", "")


def cleaned(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(spaced(text), rf"\.{{2,}}{T.SPACE}*$", ""), f"^{T.SPACE}+|{T.SPACE}+$", "")


def is_furniture(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(T.fold(spaced(text)), "^:+|:+$", "").isin(*KEYWORDS), F.lit(False))


def is_marked(title: Column) -> Column:
    return title.rlike(NUMERIC) | title.rlike(ROMAN) | title.rlike(LETTERED)


def is_structural(title: Column) -> Column:
    """Marked titles, and short ones of one sentence that are mostly capitals or of ten words at most."""
    words = F.size(F.split(T.squeeze(title), " "))
    letters, capitals = (F.char_length(F.regexp_replace(title, p, "")) for p in (r"\P{L}+", r"[^\p{Lu}]+"))
    plain = (words <= 14) & ~title.rlike(r"[.!?]\s+\S") & (letters > 0) & ((capitals / F.nullif(letters, F.lit(0)) >= 0.55) | (words <= 10))
    return F.char_length(title).between(2, TITLE) & ~title.rlike(r"^[\d.\-_()\[\]\s]+$") & F.coalesce(is_marked(title) | plain, F.lit(False))


def leading_marker(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(title, LEADING, 1)), r"\.+$", "")


def own_level(title: Column) -> Column:
    number, letter = (F.regexp_extract(title, p, 1) for p in (rf"^\s*({T.NUMBER})", r"^\s*([A-Z](?:\.\d+)+)"))
    return F.when(number != "", F.size(F.split(number, r"[.\-_]"))).when(letter != "", F.size(F.split(letter, r"\."))).otherwise(1)


def relative_level(title: Column, order: W) -> Column:
    """Roman sections are 1; after the first of them numbered titles are a level deeper."""
    inside = F.coalesce(F.max(title.rlike(ROMAN)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return F.when(title.rlike(ROMAN), 1).otherwise(own_level(title) + F.when(inside & title.rlike(NUMERIC), 1).otherwise(0))


def ordered(elements: DataFrame) -> DataFrame:
    """Elements with their position ``pos`` in the document and text in NFKC."""
    at = W.partitionBy("doc_id").orderBy("page", F.col("reading_order").asc_nulls_last(), F.col("y0").asc_nulls_last(), "element_id")
    return elements.withColumn("pos", F.row_number().over(at)).withColumn("text", nfkc("text"))


def raw_rows(elements: DataFrame) -> DataFrame:
    """(doc_id, page, pos, line, title, page_ref, printed_page) of every line or table row that ends in a page."""
    rows = elements.filter("type in ('text', 'title') and text is not null").select("doc_id", "page", "pos", F.posexplode(F.split("text", LINES)).alias("line", "t")).withColumn("t", spaced(F.col("t")))
    text = rows.filter(F.col("t").rlike(DOT_ROW)).select("doc_id", "page", "pos", "line", F.regexp_extract("t", DOT_ROW, 1).alias("title"), F.regexp_extract("t", DOT_ROW, 2).alias("page_ref"))
    lines = elements.filter("type = 'table' and contains(table_markdown, '|')").select("doc_id", "page", "pos", F.posexplode(F.split("table_markdown", LINES)).alias("line", "t")).filter("contains(t, '|')")
    bare = F.regexp_replace(T.squeeze(F.col("t")), r"^\|+|\|+$", "")
    cells = lines.withColumn("t", nfkc(F.translate(bare, "|", "\x1F"))).withColumn("c", F.filter(F.transform(F.split("t", "\x1F"), spaced), lambda c: c != ""))
    last = F.element_at("c", -1)
    table = cells.filter((F.size("c") >= 2) & ~F.forall("c", lambda c: c.rlike(RULE))).filter(last.rlike(f"^{PAGE_REF}$"))
    table = table.select("doc_id", "page", "pos", "line", F.array_join(F.slice("c", F.lit(1), F.size("c") - 1), " ").alias("title"), last.alias("page_ref"))
    both = text.unionByName(table).withColumn("title", cleaned(F.col("title")))
    both = both.filter(F.char_length("title").between(1, TITLE) & ~is_furniture(F.col("title")))
    return both.withColumn("printed_page", F.regexp_extract("page_ref", r"(\d{1,4})$", 1).cast("int"))


def index_pages(elements: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page): pages named as index and pages with rows soon after; without a name, pages of three rows."""
    named = elements.filter(is_furniture(F.when(F.col("type") == "table", nfkc("table_markdown")).otherwise(F.col("text")))).select("doc_id", "page").distinct()
    first = named.groupBy("doc_id").agg(F.min("page").alias("_f"))
    counts = rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n")).join(first, "doc_id", "left")
    more = counts.filter(F.when(F.col("_f").isNull(), F.col("n") >= ROWS).otherwise(F.col("page").between(F.col("_f"), F.col("_f") + WINDOW)))
    return named.unionByName(more.select("doc_id", "page")).distinct()


def index_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, index, level, title, page_ref, printed_page, page): rows of the index, the first of equal ones."""
    kept = rows.join(pages, ["doc_id", "page"], "left_semi")
    first = F.row_number().over(W.partitionBy("doc_id", T.fold_title(F.col("title")), T.fold(F.col("page_ref"))).orderBy("pos", "line"))
    kept = kept.withColumn("_f", first).filter("_f = 1")
    order = W.partitionBy("doc_id").orderBy("pos", "line")
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("index"), relative_level(F.col("title"), order).alias("level"), "title", "page_ref", "printed_page", "page")


def title_candidates(elements: DataFrame, pages: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headings (doc_id, index, element_id, title, page), and titles refused (doc_id, element_id, reason)."""
    t = elements.filter("type = 'title'").join(pages, ["doc_id", "page"], "left_anti").withColumn("title", cleaned(F.coalesce("text", F.lit(""))))
    reason = F.when(T.fold(F.coalesce("role", F.lit(""))).isin(*VISUAL_ROLES), "visual_caption").when((F.col("title") == "") | is_furniture(F.col("title")), "furniture_or_empty").when(~is_structural(F.col("title")), "not_structural")
    t = t.withColumns({"reason": reason, "norm": T.fold_title(F.col("title"))})
    good = t.filter("reason is null").drop("reason")
    spread = good.groupBy("doc_id", "norm").agg(F.count_distinct("page").alias("_p"))
    width = good.groupBy("doc_id").agg(F.count_distinct("page").alias("_w"))
    out = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("_x"))
    limit = width.join(totals, "doc_id").join(out, "doc_id", "left")
    body = F.greatest(F.lit(1), F.least(F.col("pages_total") - F.coalesce("_x", F.lit(0)), F.col("_w")))
    limit = limit.select("doc_id", F.greatest(F.lit(REPEAT_PAGES), F.ceil(body * REPEAT_SHARE)).alias("_l"))
    good = good.join(spread, ["doc_id", "norm"]).join(limit, "doc_id").withColumn("repeated", (F.col("_p") >= F.col("_l")) & ~is_marked(F.col("title")))
    rank = F.row_number().over(W.partitionBy("doc_id", "repeated", "page", "norm").orderBy("pos"))
    good = good.withColumn("reason", F.when(F.col("repeated"), "repeated_header").when(rank > 1, "duplicate_on_page"))
    refused = t.filter("reason is not null").select("doc_id", "element_id", "reason").unionByName(good.filter("reason is not null").select("doc_id", "element_id", "reason"))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return good.filter("reason is null").select("doc_id", index.alias("index"), "element_id", "title", "page"), refused


def fuse(rows: DataFrame, headings: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` with resolved_page, heading_index, score, decision, target (the page) and confidence."""
    vote = offset_vote(rows, headings).select("doc_id", "page_offset")
    at = F.col("printed_page") + F.col("page_offset")
    r = rows.join(vote, "doc_id", "left").join(totals, "doc_id").withColumn("resolved_page", F.when(at.between(1, F.col("pages_total")), at)).drop("page_offset")
    h = headings.select("doc_id", F.col("index").alias("h"), F.col("title").alias("ht"), F.col("page").alias("hp"))
    pairs = r.select("doc_id", "index", "title", "resolved_page").join(h, "doc_id")
    same = (leading_marker(F.col("title")) != "") & (leading_marker(F.col("title")) == leading_marker(F.col("ht")))
    score = similarity(T.fold_title(F.col("title")), T.fold_title(F.col("ht"))) + F.when(same, GAIN).otherwise(0.0)
    distance = F.coalesce(F.abs(F.col("hp") - F.col("resolved_page")), F.lit(0))
    best = pairs.groupBy("doc_id", "index").agg(F.max(F.struct(F.least(score, F.lit(1.0)).alias("s"), (-distance).alias("d"), (-F.col("h")).alias("i"), "hp")).alias("b"))
    out = r.join(best, ["doc_id", "index"], "left")
    strong, row = F.coalesce(F.col("b.s") >= MATCH, F.lit(False)), F.col("resolved_page")
    page = F.when(strong, F.col("b.hp")).otherwise(row)
    valid = F.coalesce(page.between(1, F.col("pages_total")), F.lit(False))
    agreed = F.coalesce(row == F.col("b.hp"), F.lit(False))
    return out.select(
        *rows.columns, "resolved_page", (-F.col("b.i")).alias("heading_index"), F.coalesce("b.s", F.lit(0.0)).alias("score"), F.when(~valid, "unresolved").when(strong & agreed, "confirmed").when(strong, "heading_only").otherwise("offset_only").alias("decision"),
        F.when(valid, page).alias("target"), F.when(~valid, 0.0).when(strong & agreed, CONFIRMED).when(strong, BY_TITLE).otherwise(BY_OFFSET).alias("confidence"),
    )


def _entries(found: DataFrame) -> DataFrame:
    """(doc_id, ord, level, title, page, confidence): the first of equal (level, folded title, page)."""
    first = F.row_number().over(W.partitionBy("doc_id", "level", T.fold_title(F.col("title")), "page").orderBy("index"))
    kept = found.withColumn("_f", first).filter("_f = 1")
    return kept.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("index")) - 1).alias("ord"), "level", "title", "page", "confidence")


def reconstruct_outline(elements: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, (doc_id, mode, overall_confidence, resolved_ratio) of documents that have them, and (doc_id, stage) of the others.

    A document with index pages is read from them or fails; its titles take their place only where
    there is no index page at all.
    """
    own = ordered(elements)
    raw = raw_rows(own)
    pages = index_pages(own, raw)
    rows = index_rows(raw, pages)
    headings, _ = title_candidates(own, pages, totals)
    fused = fuse(rows, headings, totals).filter("target is not null").select("doc_id", "index", "level", "title", F.col("target").alias("page"), "confidence")
    printed = _entries(fused)
    order = W.partitionBy("doc_id").orderBy("index")
    titles = headings.join(pages, "doc_id", "left_anti").select("doc_id", "index", relative_level(F.col("title"), order).alias("level"), "title", "page", F.lit(FALLBACK).alias("confidence"))

    outside = own.join(totals, "doc_id").filter("page > pages_total").select("doc_id").distinct().withColumn("_out", F.lit(True))
    state = totals.select("doc_id").join(outside, "doc_id", "left")
    for name, part in (("_pages", pages), ("_rows", rows), ("_entries", printed), ("_titles", titles)):
        state = state.join(part.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
    ratio = F.col("_entries") / F.col("_rows")
    stage = (
        F.when(F.col("_out").isNotNull(), "element_outside").when(F.col("_pages").isNull() & F.col("_titles").isNull(), "no_title").when(F.col("_pages").isNull(), None)
        .when(F.col("_rows").isNull(), "no_index_row").when(F.col("_entries").isNull(), "no_resolved_entry").when(ratio < RATIO, "low_resolution")
    )
    state = state.select("doc_id", stage.alias("stage"), F.when(F.col("_pages").isNull(), "title_fallback").otherwise("printed_index").alias("mode"), F.coalesce(F.lit(PRINTED) * ratio, F.lit(FALLBACK)).alias("overall_confidence"), ratio.alias("resolved_ratio"))
    failed = state.filter("stage is not null").select("doc_id", "stage")
    return printed.unionByName(_entries(titles)).join(failed, "doc_id", "left_anti"), state.filter("stage is null").drop("stage"), failed
