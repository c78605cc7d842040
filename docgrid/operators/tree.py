"""Trees of chapters and elements: paths, search that keeps ancestors, boundaries inside a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.functions.unicode import nfkc
from docgrid.operators import outline


def chapter_paths(chapters: DataFrame) -> DataFrame:
    """(doc_id, ord, depth, path, ancestors) of (doc_id, ord, level, title), in preorder.

    A fold over a document's entries keeps the open chapters, those of lower levels than the next
    entry, so one shuffle serves trees of any depth.
    """
    item = F.struct("ord", "level", "title")
    rows = chapters.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    kind = "array<struct<ord:bigint,level:bigint,title:string>>"
    open_ = lambda stack, x: F.filter(stack, lambda s: s["level"] < x["level"])
    start = F.struct(F.array().cast(kind).alias("stack"), F.array().cast(f"array<{kind}>").alias("out"))

    def enter(acc: Column, x: Column) -> Column:
        stack = F.concat(open_(acc["stack"], x), F.array(x))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(stack)).alias("out"))

    out = rows.select("doc_id", F.explode(F.aggregate(F.col("all").cast(kind), start, enter)["out"]).alias("s"))
    last = F.element_at("s", -1)
    ancestors = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: x["ord"])
    return out.select("doc_id", last["ord"].alias("ord"), (F.size("s") - 1).alias("depth"), F.transform("s", lambda x: x["title"]).alias("path"), ancestors.alias("ancestors"))


def search_text(*fields: Column) -> Column:
    """Fields that are neither null nor empty, joined by spaces."""
    return F.array_join(F.filter(F.array(*fields), lambda t: t.isNotNull() & (t != "")), " ")


def tree_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes of (doc_id, node_id, ancestors array, text) that contain ``query`` without regard to case, and their ancestors."""
    hits = nodes.filter(F.lower("text").contains(query.strip().lower()))
    keep = hits.select("doc_id", F.explode(F.concat(F.array("node_id"), "ancestors")).alias("node_id")).distinct()
    return nodes.join(keep, ["doc_id", "node_id"], "left_semi")


def title_anchors(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """``chapters`` (doc_id, ord, level, title, page, page_end) with anchor: the reading order of the title that opens it.

    Only on pages where two or more chapters start, and only where the folded title is that of one
    chapter and of one of ``titles`` (doc_id, page, text, reading_order).
    """
    same_page, same_title = W.partitionBy("doc_id", "page"), W.partitionBy("doc_id", "page", "_t")
    c = chapters.withColumn("_t", T.fold_title(nfkc("title"))).withColumns({"shared": F.count(F.lit(1)).over(same_page) > 1, "_n": F.count(F.lit(1)).over(same_title)})
    t = titles.select("doc_id", "page", T.fold_title(nfkc("text")).alias("_t"), "reading_order").groupBy("doc_id", "page", "_t").agg(F.count(F.lit(1)).alias("_m"), F.max("reading_order").alias("_o"))
    out = c.join(t, ["doc_id", "page", "_t"], "left")
    return out.withColumn("anchor", F.when(F.col("shared") & (F.col("_n") == 1) & (F.col("_m") == 1), F.col("_o"))).drop("_t", "_n", "_m", "_o")


def chapter_at(elements: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc_id, element_id, page, chapter_ord) of (doc_id, element_id, page, reading_order).

    On a page where several chapters start, an element belongs to the last one whose anchor it has
    passed, else to one that was open before the page; elsewhere to the deepest, then latest.
    """
    shared = anchored.filter("shared")
    pages = shared.select("doc_id", "page").distinct().withColumn("_shared", F.lit(True))
    anchors = shared.filter("anchor is not null").select("doc_id", "page", F.col("anchor").cast("long").alias("_at"), F.struct(F.col("anchor").cast("long").alias("a"), "ord").alias("_open"))
    e = elements.join(pages, ["doc_id", "page"], "left")
    # anchors and elements of a page in one order: the last anchor so far is the one that has been passed
    both = anchors.unionByName(e.filter("_shared").select("doc_id", "page", F.col("reading_order").cast("long").alias("_at"), "element_id"), allowMissingColumns=True)
    so_far = W.partitionBy("doc_id", "page").orderBy(F.col("_at").asc_nulls_first(), F.col("_open").isNull()).rowsBetween(W.unboundedPreceding, 0)
    passed = both.withColumn("_passed", F.max("_open").over(so_far)["ord"]).filter("_open is null").select("doc_id", "element_id", "_passed").distinct()
    before = outline.page_chapters(anchored, after_start=True).select("doc_id", "page", F.col("ord").alias("_before"))
    any_ = outline.page_chapters(anchored).select("doc_id", "page", F.col("ord").alias("_any"))
    out = e.join(before, ["doc_id", "page"], "left").join(any_, ["doc_id", "page"], "left").join(passed, ["doc_id", "element_id"], "left")
    return out.select("doc_id", "element_id", "page", F.when(F.col("_shared"), F.coalesce("_passed", "_before")).otherwise(F.col("_any")).alias("chapter_ord"))


def figure_number(rows: DataFrame, pattern: str = r"(?i)^\s*Fig\.?\s*(\d+)\s*$") -> DataFrame:
    """(doc_id, idx, figure) of (doc_id, idx, page, text): a figure's number in the next two rows of the page."""
    w = W.partitionBy("doc_id").orderBy("idx")
    found = []
    for k in (1, 2):
        number = F.nullif(F.regexp_extract(F.lead("text", k).over(w), pattern, 1), F.lit(""))
        found.append(F.when(F.lead("page", k).over(w) == F.col("page"), number))
    near = F.lead("page").over(w) == F.col("page")
    return rows.select("doc_id", "idx", F.coalesce(found[0], F.when(near, found[1])).alias("figure"))


def offset_vote(rows: DataFrame, headings: DataFrame, evidence: int = 2) -> DataFrame:
    """(doc_id, page_offset, titles): the offset that most titles agree on between rows and headings.

    Rows are (doc_id, title, printed_page), headings (doc_id, title, page); titles are equal when
    folded, and repeated pairs of title and page are joined once.
    """
    r = rows.select("doc_id", T.fold_title(F.col("title")).alias("t"), "printed_page").distinct()
    h = headings.select("doc_id", T.fold_title(F.col("title")).alias("t"), "page").distinct()
    votes = r.join(h, ["doc_id", "t"]).groupBy("doc_id", (F.col("page") - F.col("printed_page")).alias("page_offset")).agg(F.count_distinct("t").alias("titles"))
    best = votes.filter(F.col("titles") >= evidence).groupBy("doc_id").agg(F.min(F.struct((-F.col("titles")).alias("n"), F.abs("page_offset").alias("a"), "page_offset")).alias("b"))
    return best.select("doc_id", F.col("b.page_offset").alias("page_offset"), (-F.col("b.n")).alias("titles"))
