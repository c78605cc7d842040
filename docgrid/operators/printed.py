"""Printed contents pages: finding them, reading their rows, and fusing rows with body headings.

Lines are (doc_id, page, line_no, text, x0, y0, x1, y1, font_size, font_name, page_width,
page_height); each operator reads only the columns it needs. Boxes may be null.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docgrid.functions import text as T
from docgrid.operators.evidence import namespaces

#: Fixed values.
KEYWORDS = ("table of contents", "contents", "indice", "sommario")
MAX_DEPTH = 6
HEAD_PAGES, HEAD_SHARE, TAIL_PAGES, REFS, PAGE_SCORE = 80, 0.25, 40, 6, 80
BAND, FURNITURE, DIRECT = 0.18, 0.30, 0.85
INDEX_TITLE, BODY_TITLE = 400, 180
HEADING, FONT_PAGES, FONT_LINE, FONT_DEFAULT = 0.48, 25, 35, 10.0
MATCH, WEAK, NEAR, OVERRIDE = 0.72, 0.55, 3, 2
BOLD = "bold|black|heavy"


def in_footer(fraction: float = BAND) -> Column:
    return F.coalesce(F.col("y1") >= F.col("page_height") * (1 - fraction), F.lit(False))


def in_header_or_footer(fraction: float = BAND) -> Column:
    return F.coalesce(F.col("y0") <= F.col("page_height") * fraction, F.lit(False)) | in_footer(fraction)


def contents_page_scores(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, score) of pages at either end that look like printed contents.

    ``pages`` is (doc_id, pages_total). Scores are kept in tenths while they are summed, so that
    ties do not depend on the order of addition. At most twelve lines of a page are gathered.
    """
    total = F.col("pages_total")
    head = F.least(total, F.greatest(F.lit(HEAD_PAGES), F.ceil(total * HEAD_SHARE)))
    tail = F.greatest(F.lit(1), total - TAIL_PAGES + 1)
    seen = lines.select("doc_id", "page", "line_no", "text").join(pages, "doc_id").filter((F.col("page") <= head) | (F.col("page") >= tail))
    rank = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("line_no"))
    first = F.sort_array(F.collect_list(F.when(F.col("_n") <= 12, F.struct("_n", "text"))))
    per_page = seen.withColumn("_n", rank).groupBy("doc_id", "page").agg(
        T.fold(F.array_join(F.transform(first, lambda x: x["text"]), " ")).alias("_head"), F.count_if(F.col("text").rlike(T.TERMINAL_REF)).alias("_refs"),
        F.count_if(F.col("text").rlike(r"\.{3,}")).alias("_dots"), F.count_if(T.is_marked(F.col("text"))).alias("_marks"),
    )
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.col("_head").contains(word)
    tenths = F.when(named, 80).otherwise(0) + 10 * F.col("_refs") + 7 * F.least(F.col("_dots"), F.lit(10)) + 2 * F.least(F.col("_marks"), F.lit(12))
    return per_page.filter((named | (F.col("_refs") >= REFS)) & (tenths >= PAGE_SCORE)).select("doc_id", "page", (tenths / 10).alias("score"))


def contents_pages(scores: DataFrame) -> DataFrame:
    """(doc_id, page) of the best run of consecutive pages: highest sum, then longest, then first."""
    run = scores.withColumn("_g", F.col("page") - F.row_number().over(W.partitionBy("doc_id").orderBy("page")))
    run = run.groupBy("doc_id", "_g").agg(F.sum(F.round(F.col("score") * 10).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"), F.min("page").alias("a"))
    best = run.groupBy("doc_id").agg(F.max(F.struct("s", "n", (-F.col("a")).alias("a"))).alias("b"))
    return best.select("doc_id", F.explode(F.sequence(-F.col("b.a"), (F.col("b.n") - F.col("b.a") - 1).cast("int"))).alias("page"))


def contents_furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, norm) of header and footer lines repeated over the contents ``pages``."""
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    edge = lines.filter(in_header_or_footer()).join(pages, ["doc_id", "page"]).select("doc_id", "page", T.fold_title(F.col("text")).alias("norm")).filter("norm <> ''")
    seen = edge.groupBy("doc_id", "norm").agg(F.count_distinct("page").alias("c")).join(n, "doc_id")
    return seen.filter(F.col("c") >= F.greatest(F.lit(2), F.ceil(F.col("n") * FURNITURE))).select("doc_id", "norm")


# --- page numbers --------------------------------------------------------------------------


def page_ref_observations(lines: DataFrame) -> DataFrame:
    """(doc_id, pdf_page, prefix, printed_page, confidence): page numbers in headers and footers.

    Prefixed numbers anywhere in a line, numbers between dashes, and lines that are one number;
    of equal observations the surest stays. The three patterns and their confidences are fixed values.
    """
    clean = T.squeeze(F.col("text"))
    prefixed = F.transform(
        F.regexp_extract_all(clean, F.lit(r"(?<![A-Za-z0-9])([A-Za-z]{1,12}-\d{1,6})(?![A-Za-z0-9])"), 1),
        lambda ref: F.struct(ref.alias("ref"), F.when(F.char_length(clean) <= 24, 0.95).otherwise(0.75).alias("confidence")),
    )
    dashed = F.array(F.struct(F.regexp_extract(clean, r"(?:^|\s)-\s*(\d{1,6})\s*-(?:\s|$)", 1).alias("ref"), F.lit(0.9).alias("confidence")))
    alone = F.array(F.struct(F.when(clean.rlike(r"^\d{1,6}$"), clean).otherwise("").alias("ref"), F.lit(0.7).alias("confidence")))
    found = lines.filter(in_header_or_footer()).select("doc_id", F.col("page").alias("pdf_page"), F.explode(F.concat(prefixed, dashed, alone)).alias("o")).filter("o.ref <> ''")
    keyed = found.select("doc_id", "pdf_page", T.page_prefix(F.col("o.ref")).alias("prefix"), T.printed_number(F.col("o.ref")).alias("printed_page"), F.col("o.confidence").alias("confidence"))
    return keyed.groupBy("doc_id", "pdf_page", "prefix", "printed_page").agg(F.max("confidence").alias("confidence"))


def label_segments(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Last page of each of (doc_id, seg, start_page, prefix, first_number, style)."""
    following = F.lead("start_page").over(W.partitionBy("doc_id").orderBy("seg")) - 1
    return labels.join(pages, "doc_id").withColumn("end_page", F.coalesce(following, F.col("pages_total"))).drop("pages_total")


def page_number_map(observations: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Direct references (doc_id, prefix, printed_page, pdf_page) and offsets (doc_id, prefix, page_offset, pdf_start).

    Decimal labels of the file come before what is printed; a later segment before an earlier one.
    """
    own = labels.filter("style = 'D'").withColumn("prefix", T.fold(F.regexp_replace(T.squeeze(F.coalesce("prefix", F.lit(""))), "-+$", "")))
    own = own.withColumn("prefix", F.when(F.col("prefix") == "body", "").otherwise(F.col("prefix")))
    step = own.filter("end_page >= start_page").select("doc_id", "prefix", "seg", "start_page", "first_number", F.explode(F.sequence("start_page", "end_page")).alias("pdf_page"))
    direct = step.select("doc_id", "prefix", (F.col("first_number") + F.col("pdf_page") - F.col("start_page")).alias("printed_page"), F.struct(F.lit(1).alias("own"), F.col("seg").alias("seg"), "pdf_page").alias("v"))
    printed = observations.filter(F.col("confidence") >= DIRECT).select("doc_id", "prefix", "printed_page", F.struct(F.lit(0).alias("own"), (-F.col("pdf_page")).alias("seg"), "pdf_page").alias("v"))
    direct = direct.unionByName(printed).groupBy("doc_id", "prefix", "printed_page").agg(F.max("v").alias("v")).select("doc_id", "prefix", "printed_page", F.col("v.pdf_page").alias("pdf_page"))

    a = own.select("doc_id", "prefix", F.struct(F.lit(1).alias("own"), F.col("seg").alias("seg"), (F.col("start_page") - F.col("first_number")).alias("page_offset"), F.col("start_page").alias("pdf_start")).alias("v"))
    b = namespaces(observations).select("doc_id", "prefix", F.struct(F.lit(0).alias("own"), F.lit(0).alias("seg"), "page_offset", "pdf_start").alias("v"))
    offsets = a.unionByName(b).groupBy("doc_id", "prefix").agg(F.max("v").alias("v")).select("doc_id", "prefix", "v.page_offset", "v.pdf_start")
    return direct, offsets


def resolve_refs(refs: DataFrame, direct: DataFrame, offsets: DataFrame, pages: DataFrame, ref_col: str = "page_ref") -> DataFrame:
    """``refs`` with resolved_page: the direct page, else by the offset of its prefix, else null; null out of bounds."""
    keyed = refs.withColumns({"_prefix": T.page_prefix(F.col(ref_col)), "_number": T.printed_number(F.col(ref_col))})
    d = direct.select("doc_id", F.col("prefix").alias("_prefix"), F.col("printed_page").alias("_number"), F.col("pdf_page").alias("_direct"))
    o = offsets.select("doc_id", F.col("prefix").alias("_prefix"), F.col("page_offset").alias("_offset"))
    found = keyed.join(d, ["doc_id", "_prefix", "_number"], "left").join(o, ["doc_id", "_prefix"], "left").join(pages, "doc_id", "left")
    page = F.coalesce("_direct", F.col("_number") + F.col("_offset"))
    return found.withColumn("resolved_page", F.when(page.between(1, F.col("pages_total")), page)).drop("_prefix", "_number", "_direct", "_offset", "pages_total")


# --- rows of contents pages ----------------------------------------------------------------


def is_index_line(text: Column) -> Column:
    """Whether squeezed text is a title followed by a page reference."""
    return text.rlike(T.INDEX_LINE) & T.looks_like_title(T.clean_title(F.regexp_extract(text, T.INDEX_LINE, 1)), INDEX_TITLE)


def index_fields(text: Column, resolved: Column, max_depth: int = MAX_DEPTH) -> dict[str, Column]:
    """Columns of a squeezed line for which ``is_index_line`` holds."""
    title = T.clean_title(F.regexp_extract(text, T.INDEX_LINE, 1))
    extra = F.lit(0.72)
    for sign, gain in ((resolved.isNotNull(), 0.12), (T.is_marked(title), 0.12), (text.rlike(r"\.{3,}"), 0.04)):
        extra = extra + F.when(sign, gain).otherwise(0.0)
    return {"title": title, "page_ref": F.regexp_extract(text, T.INDEX_LINE, 2), "level": F.least(T.outline_level(title), F.lit(max_depth)), "confidence": F.least(extra, F.lit(1.0))}


def scan_index_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, page, idx, kind, raw): the text of each row of the contents pages ``lines``.

    A row is one line, or numbering followed by up to four lines, or a title that runs over up to
    four lines; roman sections stand alone. What would begin at a line, and how many lines it
    takes, depends only on the four lines after it, so it is computed for every line by a window;
    a fold over a page's lines then visits those that no earlier row has taken.
    """
    w = W.partitionBy("doc_id", "page").orderBy("line_no")
    clean = lines.select("doc_id", "page", "line_no", T.squeeze(F.col("text")).alias("t0")).filter("t0 <> ''")
    clean = clean.withColumns({"idx": F.row_number().over(w) - 1, **{f"t{k}": F.lead("t0", k).over(w) for k in range(1, 5)}})
    furniture = lambda c: T.fold(c).isin(*KEYWORDS)
    none = F.lit(None).cast("struct<take:int,raw:string>")

    # numbering, then lines up to the next numbering or section; furniture between is passed over
    numbered, parts, open_ = none, F.col("t0"), F.lit(True)
    # a title, then lines up to furniture
    wrapped, long, going = none, F.col("t0"), F.lit(True)
    for k in range(1, 5):
        t = F.col(f"t{k}")
        furn = furniture(t)
        open_ = open_ & t.isNotNull()
        if k > 1:
            open_ = open_ & (furn | ~(T.is_numbering(t) | T.is_roman(t)))
        parts = F.when(furn, parts).otherwise(F.concat_ws(" ", parts, t))
        numbered = F.coalesce(numbered, F.when(open_ & ~furn & is_index_line(parts), F.struct(F.lit(k + 1).alias("take"), parts.alias("raw"))))
        if k < 4:
            going = going & t.isNotNull() & ~furn
            long = F.concat_ws(" ", long, t)
            wrapped = F.coalesce(wrapped, F.when(going & is_index_line(long), F.struct(F.lit(k + 1).alias("take"), long.alias("raw"))))

    t0 = F.col("t0")
    kind = F.when(furniture(t0), "skip").when(is_index_line(t0), "line").when(T.is_numbering(t0), "numbering").when(T.is_roman(t0), "section").when(T.looks_like_title(t0, BODY_TITLE), "wrapped").otherwise("skip")
    found = F.when(kind.isin("line", "section"), F.struct(F.lit(1).alias("take"), t0.alias("raw"))).when(kind == "numbering", numbered).when(kind == "wrapped", wrapped)
    step = F.struct("idx", kind.alias("kind"), F.coalesce(found["take"], F.lit(1)).alias("take"), found["raw"].alias("raw"))
    page = clean.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    visit = F.aggregate(
        "steps", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen")),
        lambda acc, s: F.when(s["idx"] == acc["at"], F.struct((acc["at"] + s["take"]).alias("at"), F.concat(acc["seen"], F.array(s["idx"])).alias("seen"))).otherwise(acc),
    )
    rows = page.withColumn("seen", visit["seen"]).select("doc_id", "page", F.explode(F.filter("steps", lambda s: F.array_contains(F.col("seen"), s["idx"]) & s["raw"].isNotNull())).alias("s"))
    return rows.select("doc_id", "page", "s.idx", "s.kind", "s.raw")


def index_rows(lines: DataFrame, pages: DataFrame, direct: DataFrame, offsets: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, index, level, title, page_ref, resolved_page, source_page, raw, confidence, kind) of the contents ``pages``.

    Repeated furniture goes first; rows inside roman sections are a level deeper; of rows with the
    same folded title and reference the first stays.
    """
    furniture = contents_furniture(lines, pages)
    body = lines.join(pages, ["doc_id", "page"]).withColumn("norm", T.fold_title(F.col("text"))).join(furniture, ["doc_id", "norm"], "left_anti")
    rows = scan_index_rows(body).withColumn("page_ref", F.when(F.col("kind") == "section", "").otherwise(F.regexp_extract("raw", T.INDEX_LINE, 2)))
    rows = resolve_refs(rows, direct, offsets, totals)
    rows = rows.withColumns({c: F.when(F.col("kind") == "section", plain).otherwise(f) for c, f, plain in ((k, v, {"title": F.col("raw"), "page_ref": F.lit(""), "level": F.lit(1), "confidence": F.lit(0.76)}[k]) for k, v in index_fields(F.col("raw"), F.col("resolved_page")).items())})
    order = W.partitionBy("doc_id").orderBy("page", "idx")
    inside = F.coalesce(F.max(T.is_roman(F.col("title"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    deeper = inside & ~T.is_roman(F.col("title")) & F.col("title").rlike(T.NUMBERED)
    rows = rows.withColumn("level", F.when(deeper, F.least(F.col("level") + 1, F.lit(MAX_DEPTH))).otherwise(F.col("level")))
    first = F.row_number().over(W.partitionBy("doc_id", T.fold_title(F.col("title")), T.fold(F.col("page_ref"))).orderBy("page", "idx"))
    rows = rows.withColumn("_f", first).filter("_f = 1").withColumn("index", F.row_number().over(order) - 1)
    return rows.select("doc_id", "index", "level", "title", "page_ref", "resolved_page", F.col("page").alias("source_page"), "raw", "confidence", "kind")


# --- headings ------------------------------------------------------------------------------


def body_font_size(body: DataFrame) -> DataFrame:
    """(doc_id, body_size): median size of long lines on the first body pages; needs body_start."""
    early = body.filter((F.col("page") < F.col("body_start") + FONT_PAGES) & ~in_footer() & (F.char_length("text") > FONT_LINE) & F.col("font_size").isNotNull())
    return early.groupBy("doc_id").agg(F.median(F.round("font_size", 1)).alias("body_size"))


def heading_score(text: Column, body_size: Column) -> Column:
    """Score of cleaned text as a heading, from numbering, size, weight, case and position."""
    signs = (
        (text.rlike(T.NUMBERED) | T.is_roman(text), 0.42), (F.col("font_size") >= body_size + 0.8, 0.32), (F.lower("font_name").rlike(BOLD), 0.2),
        (T.is_upper(text) & (F.char_length(text) <= 100), 0.12), (F.col("x0") <= F.col("page_width") * 0.30, 0.05),
    )
    score = F.lit(0.0)
    for sign, gain in signs:
        score = score + F.when(sign, gain).otherwise(0.0)
    return score


def body_headings(lines: DataFrame, starts: DataFrame, skip: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, index, title, page, confidence) of body headings.

    ``starts`` is (doc_id, body_start); pages of ``skip`` (doc_id, page) are left out. Footers are
    no headings; of equal titles of a page the first stays; unmarked titles on more than a third
    of the body pages (and more than two times) go.
    """
    at = F.greatest(F.col("body_start"), F.lit(1))
    body = lines.join(starts, "doc_id").filter(F.col("page") >= at).join(skip.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    scored = body.join(body_font_size(body), "doc_id", "left").filter(~in_footer()).withColumn("title", T.clean_title(F.col("text")))
    scored = scored.filter(T.looks_like_title(F.col("title"), BODY_TITLE)).withColumn("confidence", heading_score(F.col("title"), F.coalesce("body_size", F.lit(FONT_DEFAULT))))
    scored = scored.filter(F.col("confidence") >= HEADING).withColumn("norm", T.fold_title(F.col("title")))
    first = scored.withColumn("_f", F.row_number().over(W.partitionBy("doc_id", "page", "norm").orderBy("line_no"))).filter("_f = 1")
    skipped = skip.join(starts, "doc_id").filter(F.col("page") >= at).groupBy("doc_id").agg(F.count_distinct("page").alias("_s"))
    n = totals.join(starts, "doc_id").join(skipped, "doc_id", "left").select("doc_id", F.greatest(F.lit(1), F.col("pages_total") - at + 1 - F.coalesce("_s", F.lit(0))).alias("_n"))
    counted = first.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy("doc_id", "norm"))).join(n, "doc_id")
    kept = counted.filter(~((F.col("_c") > F.greatest(F.lit(2), F.expr("_n div 3"))) & ~T.is_marked(F.col("title"))))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "line_no")) - 1
    return kept.select("doc_id", index.alias("index"), "title", "page", F.least("confidence", F.lit(1.0)).alias("confidence"))


@F.pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks of two folded texts, as difflib counts it; the order of the two matters."""
    for left, right in pairs:
        scores: dict[tuple[str, str], float] = {}
        out = []
        for a, b in zip(left, right, strict=True):
            pair = a or "", b or ""
            if pair not in scores:  # titles of an index repeat; equal ones need no matcher
                scores[pair] = 1.0 if pair[0] == pair[1] else difflib.SequenceMatcher(None, *pair).ratio()
            out.append(scores[pair])
        yield pd.Series(out, dtype="float64")


def match_headings(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, index, heading_index, heading_page, score): the best heading of each row; none if all score 0.

    A row is compared with the headings within three pages, found by equality on (doc_id, page);
    only rows without such, or without a page, meet all headings of their document.
    """
    r = rows.select("doc_id", "index", "title", "resolved_page")
    h = headings.select("doc_id", F.col("index").alias("h_index"), F.col("title").alias("h_title"), F.col("page").alias("h_page"), F.col("confidence").alias("h_confidence"))
    near = r.filter("resolved_page is not null").withColumn("h_page", F.explode(F.sequence(F.col("resolved_page") - NEAR, F.col("resolved_page") + NEAR))).join(h, ["doc_id", "h_page"])
    far = r.join(near.select("doc_id", "index").distinct(), ["doc_id", "index"], "left_anti").join(h, "doc_id")
    pairs = near.unionByName(far).withColumns({"a": T.fold_title(F.col("title")), "b": T.fold_title(F.col("h_title"))})
    distance = F.abs(F.col("h_page") - F.col("resolved_page"))
    on_page = F.when(F.col("resolved_page").isNull(), 0.0).when(distance == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - distance / 4))
    score = similarity("a", "b") * 0.55 + on_page * 0.20 + T.numbering_score(F.col("title"), F.col("h_title")) * 0.15 + F.col("h_confidence") * 0.10 + F.when(F.col("a") == F.col("b"), 0.08).otherwise(0.0)
    best = pairs.withColumn("score", F.least(score, F.lit(1.0))).filter("score > 0").groupBy("doc_id", "index").agg(F.max(F.struct("score", (-F.col("h_index")).alias("i"), "h_page")).alias("b"))
    return best.select("doc_id", "index", (-F.col("b.i")).alias("heading_index"), F.col("b.h_page").alias("heading_page"), F.col("b.score").alias("score"))


def fuse_rows(rows: DataFrame, matches: DataFrame, totals: DataFrame) -> DataFrame:
    """Decision and page of each row: (doc_id, row_index, heading_index, score, decision, page)."""
    m = rows.select("doc_id", "index", "resolved_page").join(matches, ["doc_id", "index"], "left").join(totals, "doc_id")
    row, heading, score = F.col("resolved_page"), F.col("heading_page"), F.coalesce("score", F.lit(0.0))
    strong, weak = heading.isNotNull() & (score >= MATCH), heading.isNotNull() & (score >= WEAK)
    agreed = F.when(row.isNull() | (F.abs(row - heading) <= OVERRIDE), heading).otherwise(row)
    page = F.when(strong, agreed).when(weak, F.coalesce(row, heading)).otherwise(row)
    valid = page.between(1, F.col("pages_total"))
    decision = F.when(page.isNull() | ~valid, "unresolved").when(strong, "matched").when(weak, "weak_match").otherwise("unmatched")
    return m.select("doc_id", F.col("index").alias("row_index"), "heading_index", score.alias("score"), decision.alias("decision"), F.when(valid, page).alias("page"))


def contents_entries(rows: DataFrame, fused: DataFrame) -> DataFrame:
    """(doc_id, ord, level, title, page): the outline; of equal (level, folded title, page) the first."""
    e = rows.select("doc_id", F.col("index").alias("row_index"), "level", "title").join(fused.filter("page is not null").select("doc_id", "row_index", "page"), ["doc_id", "row_index"])
    first = F.row_number().over(W.partitionBy("doc_id", "level", T.fold_title(F.col("title")), "page").orderBy("row_index"))
    e = e.withColumn("_f", first).filter("_f = 1")
    return e.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("row_index")) - 1).alias("ord"), "level", "title", "page")


def reconstruct_outline(lines: DataFrame, labels: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outline entries of all documents, and (doc_id, stage) of those that have none and why.

    ``labels`` has the columns of ``label_segments``. A document fails when it has no contents
    page, no row or no entry; the others go on.
    """
    pages = contents_pages(contents_page_scores(lines, totals))
    direct, offsets = page_number_map(page_ref_observations(lines), label_segments(labels, totals))
    rows = index_rows(lines, pages, direct, offsets, totals)
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_l"))
    starts = last.join(offsets.filter("prefix = ''").select("doc_id", "pdf_start"), "doc_id", "left").select("doc_id", F.coalesce("pdf_start", F.col("_l") + 1).alias("body_start"))
    headings = body_headings(lines, starts, pages, totals)
    entries = contents_entries(rows, fuse_rows(rows, match_headings(rows, headings), totals))
    state = totals.select("doc_id")
    for name, part in (("pages", pages), ("rows", rows), ("entries", entries)):
        state = state.join(part.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left")
    stage = F.when(F.col("pages").isNull(), "no_contents_page").when(F.col("rows").isNull(), "no_contents_row").when(F.col("entries").isNull(), "no_resolved_entry")
    failed = state.select("doc_id", stage.alias("stage")).filter("stage is not null")
    return entries.join(failed, "doc_id", "left_anti"), failed
