"""Assembly, injected readers and what SQL has no words for, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from docgrid import registry
from docgrid.operators import assembly, blocks, captions, detect, outline, review, runs
from docgrid.sources import ocr, pdf


def test_chapters_of_any_level(spark):
    levels = [3, 9, 12, 9, 7, 3, 1, 8]
    toc = spark.createDataFrame([("d", i, level, f"t{i}", i + 1) for i, level in enumerate(levels)], "doc_id string, ord int, level int, title string, page int")
    got = {r.ord: (r.parent_ord, r.page_end) for r in outline.chapters(toc, spark.createDataFrame([("d", 20)], "doc_id string, pages_total int")).collect()}
    for i, level in enumerate(levels):
        parent = next((j for j in range(i - 1, -1, -1) if levels[j] < level), None)
        end = next((max(i + 1, j) for j in range(i + 1, len(levels)) if levels[j] <= level), 20)
        assert got[i] == (parent, end)


def test_anchors_of_a_page(spark):
    """Equal titles first, then likeness with a margin, then a section's number; what is left has none."""
    chapters = [(0, None, "1 Safety"), (1, None, "2 Electrical connection of the unit"), (2, None, "3.1 Very long heading that is cut"), (3, None, "Same"), (4, None, "Same"), (5, None, "Nowhere at all")]
    c = spark.createDataFrame([("d", o, p, t, 5) for o, p, t in chapters] + [("d", 9, None, "Alone", 7)], "doc_id string, ord int, parent_ord int, title string, page int")
    titles = [(10, "1 SAFETY"), (20, "Electrical connection"), (25, "of the unit"), (40, "3.1 tail only"), (50, "same")]
    t = spark.createDataFrame([("d", 5, f"e{o}", o, x) for o, x in titles], "doc_id string, page int, element_id string, reading_order int, text string")
    rows = assembly.page_anchors(c, t).collect()
    got = {r.ord: (r.anchor, r.outcome) for r in rows}
    assert got == {0: (10, "exact"), 1: (20, "similar"), 2: (40, "number"), 3: (None, "ambiguous"), 4: (None, "ambiguous"), 5: (None, "unmatched")}
    assert assembly.page_anchors(c.limit(0), t).count() == 0


def test_assemble(spark):
    toc = spark.createDataFrame([("d", 0, 1, "One", 2), ("d", 1, 2, "One A", 2), ("d", 2, 1, "Two", 3)], "doc_id string, ord int, level int, title string, page int")
    elements = [(0, "text", 1, "before"), (1, "title", 2, "One"), (2, "text", 2, "a"), (3, "title", 2, "One A"), (4, "text", 2, "b"), (5, "text", 3, "c")]
    e = spark.createDataFrame([("d", f"e{o}", o, k, p, t, None) for o, k, p, t in elements], "doc_id string, element_id string, ord int, type string, page int, text string, reading_order int")
    chapters, placed, warnings = assembly.assemble(toc, spark.createDataFrame([("d", 3)], "doc_id string, pages_total int"), e)
    assert {r.element_id: (r.chapter_ord, r.position) for r in placed.collect()} == {"e0": (None, 0), "e1": (0, 0), "e2": (0, 1), "e3": (1, 0), "e4": (1, 1), "e5": (2, 0)}
    assert {r.chapter_id: (r.parent_ord, r.page_end, r.position) for r in chapters.collect()} == {"chapter-0001-one": (None, 2, 1), "chapter-0002-one-a": (0, 2, 2), "chapter-0003-two": (None, 3, 2)}
    assert [r.warning for r in warnings.collect()] == ["1 element(s) precede the first outline destination and remain at document root"]


def test_rounding_is_that_of_the_double(spark):
    values = [0.0005, 0.0015, 0.0025, 2.675, 1.0005, 0.9265, 0.97 - 0.25 * 3 / 7, 0.5, 0.78 + 0.2 * 6 / 7, 123.4565]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", detect.rounded(F.col("v")).alias("r")).collect()
    assert [r.r for r in got] == [round(r.v, 3) for r in got]


def injected():
    """Defined inside, so that it travels to the workers by value."""

    def reader(path):
        if "bad" in path:
            raise OSError("broken")
        line = lambda t, y: ([(t, 10.0, "Any"), (" more ", 12.5, "Any-Bold")], (10, y, 90, y + 10))
        return {"pages": [(595, 842, [line("ﬁrst", 5), ([(" ", 9, "")], None)]), (595, 842, [])], "outline": [(1, " One  two", 1)], "labels": [(2, "A-", 1, "D"), (1, "", 1, "r")], "title": " T "}

    return reader


def test_files_by_an_injected_reader(spark):
    reader = injected()
    paths = spark.createDataFrame([("/in/a.pdf",), ("/in/bad.pdf",), ("/in/c.txt",)], "source string")
    lines = {r.source: r for r in pdf.read_lines(paths, reader).collect()}
    assert (lines["/in/a.pdf"].text, lines["/in/a.pdf"].font_size, lines["/in/a.pdf"].font_name, lines["/in/a.pdf"].bbox.y1) == ("first more", 12.5, "Any", 15.0)
    assert "broken" in lines["/in/bad.pdf"].error and "not a PDF" in lines["/in/c.txt"].error
    assert [(r.title, r.page, r.confidence, r.document_title) for r in pdf.read_outline(paths, reader).filter("error is null").collect()] == [("One two", 1, 1.0, "T")]
    labels = pdf.read_labels(paths, reader).filter("error is null").orderBy("start_page").collect()
    assert [(r.start_page, r.end_page, r.prefix) for r in labels] == [(1, 1, ""), (2, 2, "A-")]
    pages, outlines = pdf.capabilities(paths, reader)
    assert {(r.page, r.chars) for r in pages.collect()} == {(1, 9), (2, 0)} and [r.has_outline for r in outlines.collect()] == [True]


def injected_model():
    def make():
        def recognise(pages):
            if any(p["page"] == 9 for p in pages):
                raise RuntimeError("no")
            return [{"page": p["page"], "angle": 0, "blocks": [{"block_label": "doc_title", "block_content": "HEAD", "block_bbox": [1, 2, 50, 60]}, {"label": "text", "text": "words.", "bbox": [1, 70, 50, 90], "order": 1}]} for p in pages]

        return recognise

    return make


def test_recognition_by_an_injected_model(spark):
    pages = spark.createDataFrame([("d", p, "x") for p in (1, 2, 3, 9)], "doc_id string, page int, asset string")
    got = ocr.recognise(pages, injected_model(), 3)
    assert {(r.page, r.batch, r.error is None) for r in got.collect()} == {(1, 0, True), (2, 0, True), (3, 0, True), (9, 1, False)}
    sizes = spark.createDataFrame([("d", p, 100.0, 100.0) for p in (1, 2, 3)], "doc_id string, page int, page_width double, page_height double")
    e = blocks.page_elements(ocr.response_blocks(got, sizes)).orderBy("reading_order").collect()
    assert [(x.element_id, x.text, x.error) for x in e][:2] == [("paddle-text-0001-0001", "words.", None), ("paddle-title-0001-0001", "HEAD", None)]
    assert ocr.request_error([]) and ocr.request_error([1, 1]) and ocr.request_error([True]) and ocr.request_error([1, 2]) is None
    assert ocr.base_address(" http://h:1/api/ ") == "http://h:1" and ocr.same_runtime({"a": "1"}, {"a": " 1 "}) and not ocr.same_runtime({"a": "1"}, None)
    assert ocr.pinned_model([{"name": "m", "digest": "sha256:AB"}], "m", "ab")["name"] == "m"


def test_turns_of_pages(spark):
    texts = ['{"res":{"doc_preprocessor_res":{"angle":90}}}', '[{"doc_preprocessor_res":{"angle":180.0}}]', '{"res":{}}', '{"res":{"doc_preprocessor_res":{"angle":45}}}', '{"res":{"doc_preprocessor_res":{"angle":"90"}}}', '{"res":{"doc_preprocessor_res":{"angle":true}}}', "no json"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", blocks.orientation(F.col("t")).alias("o")).orderBy("i").collect()
    assert [(r.o.angle, r.o.error) for r in got] == [(90, False), (180, False), (None, False), (None, True), (None, True), (None, True), (None, False)]


def test_paths_and_objects(spark):
    manifest = ['{"artifacts":{"toc":null,"assets":"x/y"}}', "{}", "[1]", None]
    got = spark.createDataFrame([(t,) for t in manifest], "t string").select(runs.artifact_paths(F.col("t")).alias("p")).collect()
    assert [(r.p.manual, r.p.toc, r.p.assets) for r in got] == [("manual.json", None, "x/y")] + [("manual.json", "toc.json", "assets")] * 3
    doc = json.dumps({"a": ["/stage/x/1.png", "/other", "/stage"], "b": {"c": "/stage/y", "n": 1}})
    df = spark.createDataFrame([(doc, "/stage/"), ("no", "/s"), (None, "/s")], "d string, r string")
    assert [r[0] and json.loads(r[0]) for r in df.select(runs.relative_paths("d", "r")).collect()] == [{"a": ["x/1.png", "/other", "."], "b": {"c": "y", "n": 1}}, None, None]
    out = spark.createDataFrame([('log\n{"a":1}\n[2]\ndone',), ("none",)], "t string").select(runs.last_object(F.col("t"))).collect()
    assert [r[0] for r in out] == ['{"a":1}', None]


def test_quarantine_is_added_to(spark, tmp_path):
    rows = spark.createDataFrame([("r", "/in/a.pdf", "/out/r", "parse", "ValueError", "m" * 5000)], "run_id string, source string, destination string, stage string, error_type string, message string")
    rows = rows.withColumns({"started_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "failed_at": F.lit("2024-01-01 00:00:01.5").cast("timestamp")})
    for _ in range(2):
        runs.write_failures(rows, str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q")).collect()
    assert len(back) == 2 and len(back[0].error_message) == 4000 and back[0].report_name == "r.failure-20240101T000001500000Z"


@pytest.mark.parametrize("name", ["enrichment_items", "caption_consistency", "trace_exclusions", "report_checks"])
def test_captions_are_read_once(spark, name):
    """A caption is cut into lines once for its canonical form and once for its review, however many rules name them."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == (6 if name == "report_checks" else 2)


def test_reviews_of_captions(spark):
    def caption(kind, seen="b", doubts="f"):
        return "\r\n".join(f" {label} :  {value} " for label, value in zip(captions.LABELS, (kind, "a", seen, "c", "d", "e", doubts), strict=True))

    given = [caption("Schema  ELETTRICO x"), caption("schema/diagramma", "un cablaggio"), caption("sicurezza", "non leggibile", "Nessuna"), caption("sicurezza"), caption("poesia"), "no caption", "", None]
    due = [captions.ELECTRICAL, captions.ELECTRICAL, captions.UNCERTAIN, None, None, None, None, None]
    rows = spark.createDataFrame([(i, c, None) for i, c in enumerate(given)], "i int, caption string, prompt_version string")
    got = rows.select("i", review.reviewed(lambda c, why: F.struct(c.alias("c"), why.alias("why"))).alias("r")).orderBy("i").collect()
    assert [x.r.why for x in got] == due
    assert [x.r.c is not None for x in got] == [True] * 4 + [False] * 4
    assert got[0].r.c.split("\n")[0] == "Tipo tecnico: schema elettrico" and got[3].r.c.split("\n")[2] == "Elementi visibili: b"
