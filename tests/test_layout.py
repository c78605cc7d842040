import json

from pyspark.sql import functions as F

from docgrid.sources import layout


def test_layout_elements(spark):
    at = lambda page, *box, **more: [{"page_no": page, "bbox": dict(zip("ltrb", box, strict=True), **more)}]
    doc = {
        "body": {"children": [{"$ref": "#/groups/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/texts/1"}, {"$ref": "#/none/9"}]},
        "groups": [{"children": [{"$ref": "#/tables/0"}, {"$ref": "#/texts/0"}]}],
        "texts": [
            {"label": "section_header", "text": " A  title ", "prov": at(1, 10, 700, 90, 650, coord_origin="BOTTOMLEFT")}, {"label": "text", "orig": "body", "prov": at(2, -5, 10, 700, 30)}, {"label": "page_footer", "text": "9", "prov": at(1, 0, 0, 9, 9)},
            {"label": "text", "text": " ", "prov": at(1, 0, 0, 9, 9)}, {"label": "text", "text": "orphan", "prov": {"page": 1, "bbox": [5, 5, 5, 9]}}, {"label": "text", "text": "held", "parent": {"$ref": "#/groups/7"}, "prov": at(1, 0, 0, 9, 9)}, {"label": "text", "text": "far", "prov": at(9, 0, 0, 9, 9)},
        ],
        "tables": [{"label": "table", "prov": at(1, 0, 0, 50, 50), "data": {"grid": [[{"text": "a|b"}, "c"], ["d"]]}}],
        "pictures": [{"label": "picture", "caption": "Pump", "prov": at(2, 0, 0, 50, 50)}],
    }
    layouts = spark.createDataFrame([("x", 0, json.dumps(doc)), ("y", 0, "no json"), ("z", 0, None)], "doc_id string, seq int, layout string")
    pages = spark.createDataFrame([(d, p, 600.0, 800.0) for d in "xyz" for p in (1, 2)], "doc_id string, page int, width double, height double")
    elements, warnings = layout.layout_elements(layouts, pages)
    got = [(r.element_id, r.text or r.caption_original or r.table_markdown, tuple(r.bbox) if r.bbox else None) for r in elements.orderBy("reading_order").collect()]
    assert got == [
        ("docling-table-0001-0001", "| a\\|b | c |\n| --- | --- |\n| d |  |", (0.0, 0.0, 50.0, 50.0)), ("docling-title-0001-0001", "A title", (10.0, 100.0, 90.0, 150.0)), ("docling-text-0002-0001", "body", (0.0, 10.0, 600.0, 30.0)),
        ("docling-text-0001-0002", "orphan", None), ("docling-image-0002-0001", "Pump", (0.0, 0.0, 50.0, 50.0)),
    ]
    assert sorted(r.warning for r in warnings.collect()) == ["empty text node", "no provenance on selected pages"]


def test_parse_pages(spark):
    cases = {"1-3,5": [1, 2, 3, 5], "7": [7], "3,1": [3, 1], "2-2": [2], "3-1": None, "1,1": None, "1-3,2": None, "0": None, "": None, " 1": None, "1,": None, "a": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", layout.parse_pages(F.col("s")).alias("p"))
    assert {r.s: r.p for r in df.collect()} == cases
