"""Layout documents (JSON with a body of references into texts, tables and pictures) as elements.

The order of the body is a walk along references, so it runs in Arrow batches, one document at a
time; choice of the page, boxes, types and ids are columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from docgrid.functions import text as T

#: Labels that are no content, and those of titles and images.
NO_CONTENT = ("page_header", "page_footer", "footnote", "unspecified")
TITLES = ("title", "section_header", "heading")
IMAGES = ("picture", "image", "figure")
COLLECTIONS = ("texts", "tables", "pictures")
LEAST_SIDE = 0.01
PROVENANCE = StructType([StructField("page", IntegerType()), StructField("box", ArrayType(DoubleType())), StructField("bottom", StringType())])
NODE = StructType([StructField("label", StringType()), StructField("text", StringType()), StructField("markdown", StringType()), StructField("grid", ArrayType(ArrayType(StringType()))), StructField("prov", ArrayType(PROVENANCE))])


def _label(node: dict) -> str:
    return str(node.get("label", node.get("type", "text"))).strip().lower()


def _is_content(node: dict) -> bool:
    return bool(node.get("prov")) and str(node.get("content_layer", "")).casefold() != "furniture" and _label(node) not in NO_CONTENT


def _target(document: object, pointer: str) -> object:
    """What a JSON pointer in a fragment names, None if nothing."""
    if not pointer.startswith("#/"):
        return None
    for part in pointer[2:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            document = document[int(part)] if isinstance(document, list) else document[part]
        except (KeyError, IndexError, ValueError, TypeError):
            return None
    return document


def content_nodes(document: dict) -> list[dict]:
    """Nodes with content in reading order: along the body, then what no reference has reached."""
    out, reached, stack = [], set(), [document.get("body")]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        pointer = node.get("$ref")
        if isinstance(pointer, str):
            if pointer in reached:
                continue
            reached.add(pointer)
            node = _target(document, pointer)
            if not isinstance(node, dict):
                continue
        if _is_content(node):
            out.append(node)
        elif isinstance(node.get("children"), list):
            stack.extend(reversed(node["children"]))
    for name in COLLECTIONS:
        rest = document.get(name)
        for i, node in enumerate(rest if isinstance(rest, list) else []):
            if f"#/{name}/{i}" not in reached and isinstance(node, dict) and _is_content(node):
                parent = node.get("parent")
                if not isinstance(parent, dict) or parent.get("$ref") in (None, "#/body"):
                    out.append(node)
    return out


def _first_text(node: dict, *keys: str) -> str | None:
    return next((node[k] for k in keys if isinstance(node.get(k), str) and node[k].strip()), None)


def _provenance(item: dict) -> dict | None:
    try:
        page = int(item.get("page_no", item.get("page")))
    except (TypeError, ValueError):
        return None
    box, origin = item.get("bbox"), ""
    if isinstance(box, dict):
        origin = str(box.get("coord_origin", item.get("coord_origin", ""))).upper()
        corners = next((k for k in (("l", "t", "r", "b"), ("x0", "y0", "x1", "y1")) if all(c in box for c in k)), None)
        origin = origin if corners and corners[0] == "l" else ""
        box = [float(box[c]) for c in corners] if corners else None
    elif isinstance(box, list) and len(box) >= 4:
        box = [float(v) for v in box[:4]]
    else:
        box = None
    return {"page": page, "box": box, "bottom": "y" if "BOTTOM" in origin else None} if page >= 1 else None


def _row(node: dict) -> dict:
    prov = node["prov"]
    items = [prov] if isinstance(prov, dict) else [p for p in prov if isinstance(p, dict)] if isinstance(prov, list) else []
    grid = node["data"].get("grid") if isinstance(node.get("data"), dict) else None
    rows = [[str((c.get("text") if isinstance(c, dict) else c) or "") for c in r] for r in grid if isinstance(r, list)] if isinstance(grid, list) else None
    return {"label": _label(node), "text": _first_text(node, "text", "orig", "caption"), "markdown": _first_text(node, "table_markdown", "markdown", "text"), "grid": [r for r in rows if r] if rows else None, "prov": [p for p in map(_provenance, items) if p]}


@F.pandas_udf(ArrayType(NODE))
def layout_nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def read(text: str | None) -> list[dict] | None:
        try:
            document = json.loads(text or "")
            return [_row(n) for n in content_nodes(document)] if isinstance(document, dict) else None
        except (ValueError, TypeError):
            return None

    for texts in batches:
        yield texts.map(read)


def page_box(box: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Corners from the top left, inside the page and in order; null where a side is almost nothing."""
    at = lambda i: F.get(box, F.lit(i))
    inside = lambda v, most: F.least(most, F.greatest(F.lit(0.0), v))
    flip = lambda v: F.when(bottom.isNotNull(), height - v).otherwise(v)
    x, y = [inside(at(i), width) for i in (0, 2)], [inside(flip(at(i)), height) for i in (1, 3)]
    corners = F.struct(F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))
    wide = (corners["x1"] - corners["x0"] > LEAST_SIDE) & (corners["y1"] - corners["y0"] > LEAST_SIDE)
    return F.when(box.isNotNull() & wide, corners)


def grid_markdown(grid: Column) -> Column:
    """Rows of cells as a pipe table whose first row is the header."""
    width = F.array_max(F.transform(grid, F.size))
    cell = lambda c: F.replace(T.squeeze(c), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = F.transform(grid, lambda r: line(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))))
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(rows, F.lit(2), F.size(rows))), "\n"))


def layout_elements(layouts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements (doc_id, element_id, type, page, reading_order, role, bbox, text, caption_original, table_markdown), and warnings.

    Layouts are (doc_id, seq, layout JSON), pages (doc_id, page, width, height) the selected ones.
    The first provenance on a selected page places a node. Titles and texts without text are left
    out with a warning (doc_id, node, warning), as are nodes on no selected page.
    """
    size = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", F.struct("width", "height")))).alias("_sizes"))
    n = layouts.select("doc_id", "seq", F.posexplode(layout_nodes("layout")).alias("_i", "n")).join(size, "doc_id")
    n = n.withColumn("node", F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "_i")))
    n = n.withColumn("p", F.get(F.filter("n.prov", lambda p: F.map_contains_key("_sizes", p["page"])), F.lit(0)))
    role, text = F.col("n.label"), T.squeeze(F.coalesce("n.text", F.lit("")))
    kind = F.when(role.isin(*TITLES), "title").when(role == "table", "table").when(role.isin(*IMAGES), "image").otherwise("text")
    n = n.withColumns({"type": kind, "t": text}).withColumn("_w", F.when(F.col("p").isNull(), "no provenance on selected pages").when(F.col("type").isin("title", "text") & (F.col("t") == ""), F.concat(F.lit("empty "), "type", F.lit(" node"))))
    kept = n.filter("_w is null").withColumn("_s", F.element_at("_sizes", F.col("p.page")))
    count = F.row_number().over(W.partitionBy("doc_id", "type").orderBy("node"))
    pad = lambda c: F.when(F.length(c.cast("string")) > 4, c.cast("string")).otherwise(F.lpad(c.cast("string"), 4, "0"))
    table = F.coalesce(F.regexp_replace("n.markdown", f"^{T.SPACE}+|{T.SPACE}+$", ""), grid_markdown(F.col("n.grid")))
    out = kept.select(
        "doc_id", F.concat_ws("-", F.lit("docling"), "type", pad(F.col("p.page")), pad(count)).alias("element_id"), "type", F.col("p.page").alias("page"), (F.row_number().over(W.partitionBy("doc_id").orderBy("node")) - 1).alias("reading_order"), role.alias("role"),
        page_box(F.col("p.box"), F.col("p.bottom"), F.col("_s.width"), F.col("_s.height")).alias("bbox"), F.when(F.col("type").isin("title", "text"), F.col("t")).alias("text"), F.when((F.col("type") == "image") & (F.col("t") != ""), F.col("t")).alias("caption_original"), F.when(F.col("type") == "table", table).alias("table_markdown"),
    )
    return out, n.filter("_w is not null").select("doc_id", "node", F.col("_w").alias("warning"))


def parse_pages(selection: Column) -> Column:
    """Pages of a selection such as 1-3,5, in order; null where it is malformed, descending or names a page twice."""
    good = selection.rlike(r"^[1-9]\d{0,8}(?:-[1-9]\d{0,8})?(?:,[1-9]\d{0,8}(?:-[1-9]\d{0,8})?)*$")
    ends = F.transform(F.split(F.when(good, selection), ","), lambda t: F.struct(F.substring_index(t, "-", 1).cast("int").alias("a"), F.substring_index(t, "-", -1).cast("int").alias("b")))
    rising = F.forall(ends, lambda e: e["a"] <= e["b"])
    pages = F.flatten(F.transform(F.when(rising, ends), lambda e: F.sequence(e["a"], e["b"])))
    return F.when(F.size(F.array_distinct(pages)) == F.size(pages), pages)
