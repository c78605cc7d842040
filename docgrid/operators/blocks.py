"""Blocks of recognised pages as typed elements.

``blocks`` is (doc_id, page, block_no, label, title_level, text, bbox array<double>, block_order,
angle, page_width, page_height); label, title_level, text, bbox and block_order may be null. Work is
by page: windows and ids never cross a page but for the reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.operators import geometry as G

#: Labels of furniture, titles, images, tables and captions; the kind of ids.
FURNITURE = ("number", "footnote", "header", "header_image", "footer", "footer_image", "aside_text", "page_header", "page_footer")
TITLES = ("title", "doc_title", "document_title", "paragraph_title", "section_title", "section_header", "heading")
IMAGES = ("image", "figure", "picture", "chart", "seal")
TABLES = ("table", "table_body")
CAPTIONS = ("figure_title", "figure_caption", "image_caption", "table_title", "table_caption")
KIND = "paddle"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def element_type(role: Column, level: Column) -> Column:
    title = F.coalesce(level > 0, F.lit(False)) | role.isin(*TITLES) | role.endswith("_title")
    return F.when(role.isin(*CAPTIONS), "text").when(title, "title").when(role.isin(*IMAGES), "image").when(role.isin(*TABLES), "table").otherwise("text")


def is_embedded_title(line: Column) -> Column:
    """A short line that is numbered or mostly in capitals and does not end as a sentence does."""
    clean = T.squeeze(line)
    bare = F.rtrim(F.regexp_replace(clean, r":+$", ""))
    letters, capitals = (F.char_length(F.regexp_replace(bare, p, "")) for p in (r"\P{L}+", r"\P{Lu}+"))
    shape = F.char_length(clean).between(1, 120) & (F.size(F.split(clean, " ")) <= 12) & ~clean.contains("...") & ~clean.rlike(r"[.;,]$")
    return F.coalesce(shape & (letters >= 2) & (bare.rlike(T.NUMBERED) | (capitals >= letters * F.lit(0.75))), F.lit(False))


def embedded_titles(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, segment, type, text) of (keys, text): the lines that are titles, and what stands between them.

    One window over the lines of a text; texts without such a line are one segment.
    """
    lines = texts.select(*keys, F.posexplode(F.split("text", LINE_END)).alias("_i", "_line")).withColumn("_t", is_embedded_title(F.col("_line")))
    order = W.partitionBy(*keys).orderBy("_i")
    starts = F.col("_t") | F.coalesce(F.lag("_t").over(order), F.lit(True))
    lines = lines.withColumn("_starts", starts).withColumn("segment", F.count(F.when(F.col("_starts"), 1)).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    whole = lines.groupBy(*keys, "segment").agg(F.bool_or("_t").alias("_t"), F.sort_array(F.collect_list(F.struct("_i", "_line"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")
    return whole.select(*keys, F.col("segment").cast("int").alias("segment"), F.when(F.col("_t"), "title").otherwise("text").alias("type"), F.when(F.col("_t"), T.squeeze_ends(body)).otherwise(body).alias("text"))


def page_elements(blocks: DataFrame) -> DataFrame:
    """(doc_id, element_id, type, page, text, bbox, reading_order, role, heading_level, error), in reading order.

    Blocks stand in the order they declare, else by their place, else as they come. Furniture and
    empty texts go; a short text that looks like a title is one, and a text is cut at the titles
    inside of it. An image or table without a box has an error, as has a page with an unknown turn.
    """
    role = F.lower(T.squeeze_ends(F.coalesce("label", F.lit("text"))))
    b = blocks.withColumn("role", role).filter(~F.col("role").isin(*FURNITURE)).withColumn("_type", element_type(F.col("role"), F.col("title_level")))
    raw = T.squeeze_ends(F.coalesce("text", F.lit("")))
    b = b.withColumn("_text", F.when(F.col("_type") == "table", raw).otherwise(T.squeeze_lines(raw)))
    lone = (F.col("_type") == "text") & ~F.col("_text").contains("\n") & is_embedded_title(F.col("_text"))
    b = b.withColumn("_type", F.when(lone, "title").otherwise(F.col("_type"))).filter(~F.col("_type").isin("title", "text") | (F.col("_text") != ""))
    at = lambda i: F.when(F.size("bbox") >= 4, F.get("bbox", F.lit(i)))
    b = b.withColumn("bbox_", G.placed_box(at(0), at(1), at(2), at(3), F.col("page_width"), F.col("page_height"), F.col("angle")))
    tier = F.when(F.col("block_order").isNotNull(), 0).when(F.size("bbox") >= 2, 1).otherwise(2)
    first = F.when(tier == 0, F.col("block_order").cast("double")).when(tier == 1, F.get("bbox", F.lit(1))).otherwise(F.col("block_no").cast("double"))
    second = F.when(tier == 1, F.get("bbox", F.lit(0))).otherwise(0.0)
    b = b.withColumn("_place", F.struct(tier.alias("t"), first.alias("a"), second.alias("b"), F.col("block_no").alias("n")))
    error = F.when(~F.coalesce(F.col("angle").isin(*G.ANGLES), F.lit(False)), "angle").when(~G.page_is_valid(F.col("page_width"), F.col("page_height")), "page").when(F.col("_type").isin("image", "table") & F.col("bbox_").isNull(), "no_box")
    b = b.withColumn("error", error)

    keys = ("doc_id", "page", "block_no")
    cut = embedded_titles(b.filter((F.col("_type") == "text") & F.col("_text").contains("\n")).select(*keys, F.col("_text").alias("text")), *keys)
    titled = cut.join(cut.filter("type = 'title'").select(*keys).distinct(), list(keys), "left_semi").withColumnsRenamed({"type": "_t", "text": "_s"})
    e = b.join(titled, list(keys), "left").withColumn("type", F.coalesce("_t", "_type")).withColumn("text", F.coalesce("_s", "_text"))
    inner = F.col("_t").isNotNull()
    e = e.withColumn("role", F.when(inner & (F.col("_t") == "title"), F.concat("role", F.lit(":embedded_title"))).otherwise(F.col("role")))
    order = ["page", "_place", F.coalesce("segment", F.lit(0))]
    e = e.withColumns({"reading_order": F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1, "_n": F.row_number().over(W.partitionBy("doc_id", "page", "type").orderBy(*order))})
    four = lambda c: F.when(c > 9999, c.cast("string")).otherwise(F.lpad(c.cast("string"), 4, "0"))
    return e.select(
        "doc_id", F.concat_ws("-", F.lit(KIND), "type", four(F.col("page")), four(F.col("_n"))).alias("element_id"), "type", "page", F.nullif("text", F.lit("")).alias("text"), F.col("bbox_").alias("bbox"), "reading_order", F.nullif("role", F.lit("")).alias("role"),
        F.when(~inner & (F.col("title_level") > 0), F.col("title_level")).alias("heading_level"), "error",
    )


def orientation(raw: Column) -> Column:
    """(angle, error) of a page's recognition as JSON text: null without one, an error unless it is a known number."""
    doc = F.try_parse_json(raw)
    value = F.coalesce(*(F.try_variant_get(doc, path, "variant") for path in ("$.res.doc_preprocessor_res.angle", "$.doc_preprocessor_res.angle", "$[0].res.doc_preprocessor_res.angle", "$[0].doc_preprocessor_res.angle")))
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(value, "$", "double"))
    good = F.coalesce(number.isin(*(float(a) for a in G.ANGLES)), F.lit(False))
    return F.struct(F.when(good, number.cast("int")).alias("angle"), (value.isNotNull() & ~good).alias("error"))


def page_set_errors(asked: DataFrame, given: DataFrame) -> DataFrame:
    """(doc_id, page, error): pages of (doc_id, page) that were asked and not given, not asked, or given twice."""
    a = asked.select("doc_id", "page").distinct().withColumn("_a", F.lit(True))
    g = given.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("_n"))
    both = a.join(g, ["doc_id", "page"], "full_outer")
    error = F.when(F.col("_a").isNull(), "unrequested").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return both.select("doc_id", "page", error.alias("error")).filter("error is not null")


def batches(pages: DataFrame, size: int = 6) -> DataFrame:
    """``pages`` (doc_id, page) with the number of their batch of ``size`` pages in a row."""
    return pages.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("page")) - 1) / size).cast("int"))
