"""Whole profiles on small documents."""

from docgrid.plans import profiles

ELEMENT = "doc_id string, element_id string, ord int, type string, page int, text string, reading_order int"


def test_documents_with_bookmarks(spark):
    toc = spark.createDataFrame([("a", 0, 1, "One", 1), ("a", 1, 1, "Two", 2), ("b", 0, 1, "Far", 9)], "doc_id string, ord int, level int, title string, page int")
    totals = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "doc_id string, pages_total int")
    elements = spark.createDataFrame([("a", "e1", 0, "text", 1, "x", 0), ("a", "e2", 1, "text", 2, "y", 1), ("c", "e1", 0, "text", 1, "x", 0), ("c", "e1", 1, "text", 3, "x", 1)], ELEMENT)
    out = profiles.digital_outline(toc, totals, elements)
    assert {(r.element_id, r.chapter_ord) for r in out.elements.collect()} == {("e1", 0), ("e2", 1)}
    assert {(r.doc_id, r.stage) for r in out.failed.collect()} == {("b", "outline"), ("c", "element"), ("c", "no_outline")}
    assert {r.chapter_id for r in out.chapters.collect()} == {"chapter-0001-one", "chapter-0002-two"}


def test_scanned_documents(spark):
    kind = "doc_id string, page int, block_no int, label string, title_level int, text string, bbox array<double>, block_order int, angle int, page_width double, page_height double"
    block = lambda doc, page, n, label, text: (doc, page, n, label, None, text, [0.0, 10.0 * n, 90.0, 10.0 * n + 9], None, 0, 100.0, 100.0)
    index = "\n".join(f"{t} ..... {p}" for t, p in (("1 Pumps", 1), ("2 Valves", 2)))
    rows = [block("a", 1, 0, "title", "Index"), block("a", 1, 1, "text", index), block("a", 3, 0, "doc_title", "1 Pumps"), block("a", 3, 1, "text", "about pumps."), block("a", 4, 0, "doc_title", "2 Valves"), block("a", 4, 1, "text", "about valves.")]
    rows += [block("e", 1, 0, "text", "words."), ("x", 1, 0, "image", None, None, None, None, 0, 100.0, 100.0), block("x", 1, 1, "doc_title", "1 Head")]
    totals = spark.createDataFrame([("a", 4), ("e", 1), ("x", 1)], "doc_id string, pages_total int")
    embedded = spark.createDataFrame([("e", 0, 1, "All", 1)], "doc_id string, ord int, level int, title string, page int")
    out = profiles.scanned_ocr(spark.createDataFrame(rows, kind), totals, embedded)
    got = {(r.doc_id, r.element_id): (r.chapter_ord, r.include_in_rag) for r in out.elements.collect()}
    assert got["a", "paddle-text-0003-0001"] == (0, True) and got["a", "paddle-text-0004-0001"] == (1, True)
    assert got["a", "paddle-text-0001-0001"] == (None, False) and got["e", "paddle-text-0001-0001"] == (0, True)
    assert {(r.doc_id, r.title, r.page) for r in out.entries.collect()} == {("a", "1 Pumps", 3), ("a", "2 Valves", 4), ("e", "All", 1)}
    assert {(r.doc_id, r.stage) for r in out.failed.collect()} == {("x", "block_no_box")}


def test_schema_is_printed(capsys):
    from docgrid.__main__ import main

    assert main(["schema", "toc"]) == 0 and "level" in capsys.readouterr().out
