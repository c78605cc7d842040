from docgrid.operators import scanned

KIND = "doc_id string, element_id string, type string, page int, reading_order int, y0 double, role string, text string, table_markdown string"


def el(doc, n, kind, page, text=None, table=None, role=None):
    return (doc, f"e{n}", kind, page, n, None, role, text, table)


def index(doc, rows, table):
    if table:
        return [el(doc, 1, "title", 1, "INDICE:"), el(doc, 2, "table", 2, table="\n".join(["| Titel | Seite |", "|--|--|", *(f"| {t} | {p} |" for t, p in rows)]))]
    return [el(doc, 1, "title", 1, "Index"), el(doc, 2, "text", 1, "\n".join(f"{t} …… {p}" for t, p in rows))]


def test_outlines(spark):
    rows = [("1 Pumps", 1), ("1.1 Cold water", 2), ("II. Valves", 4), ("3 Fault finding", 6)]
    titles = [el(d, 10 + p, "title", p + 3, t) for d in "ab" for t, p in rows[:3]]
    data = index("a", rows, False) + index("b", rows, True) + titles
    data += [el("c", 1, "title", 2, "IV. First"), el("c", 2, "title", 3, "2.1 Second"), el("c", 3, "title", 3, "2.1 second"), el("c", 4, "title", 4, "Figure", role="figure_title"), el("c", 5, "title", 4, "12.3")]
    data += [el("c", 10 + p, "title", p, "Page header") for p in range(5, 9)]
    data += [el("d", 1, "text", 1, "prose"), el("e", 1, "title", 1, "Contents"), *index("f", [("1 Alpha", 3), ("2 Beta", 4)], False), el("g", 1, "title", 9, "1 Out")]
    totals = spark.createDataFrame([(d, 12 if d in "abc" else 5) for d in "abcdefg"], "doc_id string, pages_total int")
    elements = spark.createDataFrame(data, KIND)
    entries, state, failed = scanned.reconstruct_outline(elements, totals)
    got = {}
    for r in entries.orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.level, r.title, r.page, r.confidence))
    printed = [(1, "1 Pumps", 4, 0.96), (2, "1.1 Cold water", 5, 0.96), (1, "II. Valves", 7, 0.96), (2, "3 Fault finding", 9, 0.84)]
    assert got == {"a": printed, "b": printed, "c": [(1, "IV. First", 2, 0.55), (3, "2.1 Second", 3, 0.55)]}
    assert {(r.doc_id, r.mode, r.overall_confidence) for r in state.collect()} == {("a", "printed_index", 0.9), ("b", "printed_index", 0.9), ("c", "title_fallback", 0.55)}
    assert {tuple(r) for r in failed.collect()} == {("d", "no_title"), ("e", "no_index_row"), ("f", "no_resolved_entry"), ("g", "element_outside")}
    own = scanned.ordered(elements)
    pages = scanned.index_pages(own, scanned.raw_rows(own))
    refused = scanned.title_candidates(own, pages, totals)[1].filter("doc_id = 'c'").groupBy("reason").count().collect()
    assert {(r.reason, r["count"]) for r in refused} == {("duplicate_on_page", 1), ("visual_caption", 1), ("not_structural", 1), ("repeated_header", 4)}
