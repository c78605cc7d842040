"""Queries of a reader of finished runs: trees, labels, families of checks, neighbours, safe addresses.

``nodes`` are chapters and elements in one order: (doc_id, node_id, ord, parent, type, page, title, text,
caption_original), ``ord`` being the place in the whole document, front to back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.functions import text as T

#: Families of checks by the first part of their id, in order; drawing of trees; lengths.
FAMILIES = (
    ("family.files", ("run", "manifest", "artifacts", "diagnostics", "validation")),
    ("family.structure", ("manual", "toc", "pages", "ids", "trace", "source", "run_id")),
    ("family.content", ("assets", "captions", "tables")),
    ("family.status", ("promotion", "status")),
)
OTHER = "family.other"
LABEL, TOP, CHILDREN, LINES = 64, 3, 2, 7


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def record_label(kind: Column, title: Column, caption: Column, text: Column, page: Column) -> Column:
    """What a node is called: a chapter's title; else the caption, the head of the text, or type and page."""
    other = F.concat(kind, F.lit(" · "), page.cast("string"))
    return F.when(kind == "chapter", title).otherwise(F.coalesce(_some(caption), _some(F.substring(text, 1, LABEL)), other))


def check_families(checks: DataFrame) -> DataFrame:
    """(doc_id, place, family, checks, failed) of (doc_id, check_id, passed): families with failures first, else in their order."""
    prefix = F.substring_index("check_id", ".", 1)
    number = F.lit(len(FAMILIES))
    name = F.lit(OTHER)
    for k, (family, prefixes) in reversed(list(enumerate(FAMILIES))):
        number, name = F.when(prefix.isin(*prefixes), k).otherwise(number), F.when(prefix.isin(*prefixes), family).otherwise(name)
    groups = checks.groupBy("doc_id", number.alias("_k"), name.alias("family")).agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))
    order = W.partitionBy("doc_id").orderBy(F.when(F.col("failed") > 0, 0).otherwise(1), "_k")
    return groups.withColumn("place", F.row_number().over(order)).drop("_k")


def type_counts(nodes: DataFrame, *kinds: str) -> DataFrame:
    """One row a document: nodes of each type."""
    return nodes.groupBy("doc_id").agg(*(F.count_if(F.col("type") == k).alias(k) for k in kinds))


def first_failed(checks: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` failed checks of each report, in its order (doc_id, ord, check_id, passed)."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))
    return checks.filter(~F.col("passed")).withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def neighbours(records: DataFrame) -> DataFrame:
    """``records`` (doc_id, ord, node_id, page) with the node and the page before and after each."""
    order = W.partitionBy("doc_id").orderBy("ord")
    names = {"previous": F.lag("node_id").over(order), "following": F.lead("node_id").over(order), "previous_page": F.lag("page").over(order), "following_page": F.lead("page").over(order)}
    return records.withColumns(names)


def tree_lines(nodes: DataFrame, most: int = LINES) -> DataFrame:
    """(doc_id, line, prefix, text, page): the first nodes of the root and the first elements below each, drawn as a tree."""
    chapter = F.col("type") == "chapter"
    top_text = F.when(chapter, F.col("title")).otherwise(F.coalesce(_some(F.col("text")), _some(F.col("caption_original")), F.col("type")))
    top = nodes.filter("parent is null").withColumn("_t", F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))).filter(F.col("_t") <= TOP)
    top = top.withColumn("_last", F.col("_t") == F.max("_t").over(W.partitionBy("doc_id")))
    below = nodes.filter(F.col("parent").isNotNull() & ~chapter).select("doc_id", F.col("parent").alias("node_id"), "ord", F.coalesce(_some(F.col("caption_original")), _some(F.col("text")), F.col("type")).alias("_text"), F.col("page").alias("_page"))
    below = below.join(top.filter(chapter).select("doc_id", "node_id", "_t", "_last"), ["doc_id", "node_id"])
    below = below.withColumn("_c", F.row_number().over(W.partitionBy("doc_id", "node_id").orderBy("ord"))).filter(F.col("_c") <= CHILDREN)
    ends = F.col("_c") == F.max("_c").over(W.partitionBy("doc_id", "node_id"))
    branch = lambda last: F.when(last, "└─ ").otherwise("├─ ")
    lines = top.select("doc_id", "_t", F.lit(0).alias("_c"), branch(F.col("_last")).alias("prefix"), top_text.alias("text"), "page")
    lines = lines.unionByName(below.select("doc_id", "_t", "_c", F.concat(F.when(F.col("_last"), "   ").otherwise("│  "), branch(ends)).alias("prefix"), F.col("_text").alias("text"), F.col("_page").alias("page")))
    lines = lines.withColumn("line", F.row_number().over(W.partitionBy("doc_id").orderBy("_t", "_c"))).filter(F.col("line") <= most)
    return lines.select("doc_id", "line", "prefix", "text", "page")


def description_fields(text: Column) -> Column:
    """(label, value) of each line that is not empty, cut at its first colon; null where a line has none."""
    lines = F.filter(F.split(text, "\n"), lambda t: t != "")
    parts = F.transform(lines, lambda t: F.struct(F.substring_index(t, ":", 1).alias("label"), T.squeeze_ends(F.regexp_replace(t, "^[^:]*:", "")).alias("value")))
    return F.when(~F.exists(lines, lambda t: ~t.contains(":")), parts)


def shown_table(markdown: Column) -> Column:
    """The cells of a pipe table by row, the second of which rules it; null where widths differ or there is no rule."""
    bare = lambda line: F.regexp_replace(F.regexp_replace(T.squeeze_ends(line), r"^\|", ""), r"\|$", "")
    cells = lambda line: F.transform(F.split(bare(line), r"(?<!\\)\|", -1), lambda c: F.replace(T.squeeze_ends(c), F.lit("\\|"), F.lit("|")))
    rows = F.transform(F.split(T.squeeze_ends(markdown), "\n", -1), cells)
    good = F.forall(F.get(rows, F.lit(1)), lambda c: c.rlike("^:?-+:?$")) & F.forall(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0))))
    return F.when(F.coalesce((F.size(rows) >= 2) & good, F.lit(False)), rows)


def quoted(value: Column) -> Column:
    """A word for a shell."""
    return F.when(value.rlike(r"^[A-Za-z0-9_./-]+$"), value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def command(program: Column, source: Column, run_id: Column, ranges: Column, previews: Column, enriched: Column) -> Column:
    """The command that a run was made by; null ranges are all pages."""
    return F.concat_ws(" ", program, F.lit("ingest"), quoted(source), F.lit("--out"), quoted(run_id), F.when(ranges != "", F.concat(F.lit("--pages "), ranges)), F.when(previews, F.lit("--page-previews")), F.when(~enriched, F.lit("--no-enrich")))


def safe_address(path: Column) -> Column:
    """Whether a decoded path stays below its base: relative, without a scheme and without two dots; false where it cannot be decoded."""
    decoded = F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))
    bad = (T.squeeze(decoded) == "") | decoded.startswith("/") | decoded.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | F.array_contains(F.split(decoded, "/"), "..")
    return F.coalesce(~bad, F.lit(False))


def page_raster(assets: Column, page: Column) -> Column:
    """Where a page's picture is, below a folder of assets; null for an unsafe folder and pages under 1."""
    number = F.when(page > 9999, page.cast("string")).otherwise(F.lpad(page.cast("string"), 4, "0"))
    return F.when(safe_address(assets) & (page >= 1), F.concat(F.regexp_replace(assets, "/+$", ""), F.lit("/pages/page_"), number, F.lit(".png")))


#: What a run must say alike in two places: error, column, column.
ALIKE = (("manual_id", "run_id", "manual_id"), ("source", "source_file", "manual_file"), ("detected", "profile", "detected_profile"), ("manual_profile", "profile", "manual_profile"))


def contradictions(runs: DataFrame) -> DataFrame:
    """(doc_id, error) of one row a run; report_id and report_status are null without a report."""
    rules = [(name, ~F.col(a).eqNullSafe(F.col(b))) for name, a, b in ALIKE]
    rules += [("report_id", F.col("report_id").isNotNull() & (F.col("report_id") != F.col("run_id"))), ("not_passed", (F.col("status") == "validated") & ~F.col("report_status").eqNullSafe(F.lit("passed")))]
    found = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())
    return runs.select("doc_id", F.explode(found).alias("error"))
