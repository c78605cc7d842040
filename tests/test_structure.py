"""Printed contents, tables, captions and paths on small cases, against plain walks written here."""

import random
import re

from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.operators import bundle, captions, printed, tables, tree

LINE = "doc_id string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, font_name string, page_width double, page_height double"


def one(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def line(doc, page, n, text, size=10.0, font="Any", y=400.0, x=50.0):
    return (doc, page, n, text, x, y, x + 100, y + 10, size, font, 595.0, 842.0)


def test_text_functions(spark):
    assert one(spark, T.fold_title, ["1.2  Straße & Weg!", "STRASSE", "Ὀδυσσεύς", "", None]) == ["1 2 strasse weg", "strasse", "ὀδυσσεύσ", "", None]
    assert one(spark, T.squeeze, [" a \x1cb \n", None]) == ["a b", None]
    assert one(spark, T.is_marked, ["1.2 a", "12a", "A.1 b", "A b", "IV. c", "IV.c", "3"]) == [True, False, True, False, True, False, True]
    assert one(spark, T.outline_level, ["1.2.3 x", "IV. x", "A.1 x", "plain", "1-2 x"]) == [3, 1, 2, 1, 2]
    assert one(spark, T.page_prefix, ["A-12", "Body-3", "b7", "9"]) == ["a", "", "b", ""]
    assert one(spark, T.safe_path, ["a/b", "../a", "/a", "a\\..\\b", "C:x", ".", "", None, "a/./b"]) == [True, False, False, False, False, False, False, False, True]
    assert one(spark, T.safe_component, ["a b", " a", "a/b", "..", "", None, "a\n"]) == [True, False, False, False, False, False, False]
    assert one(spark, T.provider_name, ["OllamaCaptionProvider", "MyOwn", "Provider"]) == ["ollama", "my_own", "provider"]
    assert one(spark, lambda c: T.truncate(c, 4), ["abcd", "abcde", " a  b "]) == ["abcd", "abc…", "a b"]


def walk(lines):
    """Rows of a page by going through its lines one after the other."""
    full = re.compile(r"(.+?)(?:\.{2,}|\s+)((?:[A-Za-z]{1,12}-?)?\d{1,6})")

    def row(text):
        m = full.fullmatch(text)
        if not m:
            return False
        title = re.sub(r"\.{2,}$", "", m[1]).strip()
        return 3 <= len(title) <= 400 and sum(map(str.isalpha, title)) >= 2

    furniture = lambda t: t.lower() in printed.KEYWORDS
    number = lambda t: bool(re.fullmatch(r"\d+(?:[.\-_]\d+)*|[A-Z](?:\.\d+)*", t))
    section = lambda t: bool(re.fullmatch(r"[IVXLCDM]+\.(?:\s+\S.*)?", t))
    lines = [t for t in (" ".join(t.split()) for t in lines) if t]
    out, i = [], 0
    while i < len(lines):
        t, taken = lines[i], 1
        if furniture(t):
            pass
        elif row(t):
            out.append(("line", t))
        elif number(t):
            text = t
            for j in range(i + 1, min(i + 5, len(lines))):
                if furniture(lines[j]):
                    continue
                if j > i + 1 and (number(lines[j]) or section(lines[j])):
                    break
                text += " " + lines[j]
                if row(text):
                    out.append(("numbering", text))
                    taken = j - i + 1
                    break
        elif section(t):
            out.append(("section", t))
        elif len(t) >= 3 and len(t) <= 180 and sum(map(str.isalpha, t)) >= 2:
            text = t
            for j in range(i + 1, min(i + 4, len(lines))):
                if furniture(lines[j]):
                    break
                text += " " + lines[j]
                if row(text):
                    out.append(("wrapped", text))
                    taken = j - i + 1
                    break
        i += taken
    return out


def test_scan_index_rows(spark):
    rng = random.Random(5)
    pieces = ["1.2", "3", "B.4", "IV. Part", "I.", "Pumps", "Filling valves .... 12", "and seals", "A-7", "99", "Contents", "", "x", "  Tail   end", "4.1 Cold ... 8", "indice", "..", "Oil 3b"]
    pages = {(d, p): [rng.choice(pieces) for _ in range(rng.randrange(0, 25))] for d in range(8) for p in range(8)}
    rows = [(str(d), p, n, t) for (d, p), lines in pages.items() for n, t in enumerate(lines)]
    got = printed.scan_index_rows(spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string")).orderBy("doc_id", "page", "idx").collect()
    want = [(str(d), p, *r) for (d, p), lines in sorted(pages.items()) for r in walk(lines)]
    assert [(r.doc_id, r.page, r.kind, r.raw) for r in got] == want and len(want) > 100


def manual(doc, numbers=True):
    """Ten pages: contents on page 2, then chapters; printed numbers lag two behind."""
    lines = [line(doc, 1, 0, "A guide"), line(doc, 2, 0, "Contents")]
    titles = [("1", "Pumps", 4), ("1.1", "Cold water", 5), ("2", "Valves", 7), ("3", "Fault finding", 9)]
    lines += [line(doc, 2, k + 1, f"{n} {t} ..... {p - 2}") for k, (n, t, p) in enumerate(titles)] + [line(doc, 2, 9, "Lost chapter ..... 90")]
    for n, t, p in titles:
        lines.append(line(doc, p, 0, f"{n} {t}", size=14.0, font="Any-Bold"))
        lines.append(line(doc, p, 1, "Some body text that is long enough to be sampled for its size.", size=10.0))
    if numbers:
        lines += [line(doc, p, 20, f"- {p - 2} -", y=820.0) for p in range(3, 11)]
    return lines


def test_reconstruct_outline(spark):
    lines = spark.createDataFrame(manual("a") + [line("b", 1, 0, "nothing here")] + [line("c", 1, 0, "Contents")], LINE)
    totals = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1), ("d", 3)], "doc_id string, pages_total int")
    labels = spark.createDataFrame([], "doc_id string, seg int, start_page int, prefix string, first_number int, style string")
    entries, failed = printed.reconstruct_outline(lines, labels, totals)
    assert [tuple(r) for r in entries.orderBy("doc_id", "ord").collect()] == [("a", 0, 1, "1 Pumps", 4), ("a", 1, 2, "1.1 Cold water", 5), ("a", 2, 1, "2 Valves", 7), ("a", 3, 1, "3 Fault finding", 9)]
    assert {tuple(r) for r in failed.collect()} == {("b", "no_contents_page"), ("c", "no_contents_row"), ("d", "no_contents_page")}
    empty, none = printed.reconstruct_outline(lines.limit(0), labels, totals.limit(0))
    assert empty.count() == none.count() == 0


def test_labels_before_print(spark):
    labels = spark.createDataFrame([("a", 0, 1, None, 1, "r"), ("a", 1, 3, "A-", 10, "D"), ("a", 2, 5, None, 1, "D")], "doc_id string, seg int, start_page int, prefix string, first_number int, style string")
    totals = spark.createDataFrame([("a", 8)], "doc_id string, pages_total int")
    seen = spark.createDataFrame([("a", 7, "", 1, 0.9), ("a", 8, "x", 5, 0.9), ("a", 8, "y", 5, 0.75)], "doc_id string, pdf_page int, prefix string, printed_page int, confidence double")
    direct, offsets = printed.page_number_map(seen, printed.label_segments(labels, totals))
    refs = spark.createDataFrame([("a", r) for r in ("A-11", "1", "4", "5", "X-5", "y5", "A12", "?")], "doc_id string, page_ref string")
    got = {r.page_ref: r.resolved_page for r in printed.resolve_refs(refs, direct, offsets, totals).collect()}
    assert got == {"A-11": 4, "1": 5, "4": 8, "5": None, "X-5": 8, "y5": None, "A12": 5, "?": None}


def test_markdown_tables():
    read = tables.read_table
    assert read(None) == read(" \n&nbsp;") == ("unavailable", [], [])
    assert read("| a | b |\n|---|:---:|\n| 1 | x\\|y |\n||\n| 2 |") == ("structured", ["a", "b"], [["1", "x|y"], ["2", ""]])
    assert read("a | A |  \n---|---|---\n1|2|3") == ("structured", ["a", "A [colonna 2]", "Colonna 3"], [["1", "2", "3"]])
    assert read("|a|b|\n|---|---|") == ("structured", ["Colonna 1", "Colonna 2"], [["a", "b"]])
    assert read("|a|b|") == ("structured", ["Colonna 1", "Colonna 2"], [["a", "b"]])
    for bad in ("|a|\n|b|", "|---|\n|a|", "|a|\n|---|\n|---|", "|a|\n|b|\n|---|", "no table", "|a|\n|--|\n|b|", "|a|\ntext"):
        assert read(bad)[0] == "fallback", bad


def test_html_tables():
    read = tables.read_table
    got = read("<table><tr><th rowspan=2>K</th><th colspan=2>V &amp; W</th></tr><tr><th>a</th><th>b</th></tr><tr><td>1<br>x</td><td rowspan='2'>2<table><tr><td>in</td></tr></table></td><td>3</td></tr><tr><td>4<td>5</table><table><tr><td>no</table>")
    assert got == ("structured", ["K", "V & W / a", "V & W / b"], [["1 x", "2", "3"], ["4", "2", "5"]])
    assert read("<TABLE><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></TABLE>") == ("structured", ["a", "b"], [["1", ""]])
    assert read("<table><tr><th>a<th>b</tr><tr><th>c<th>b</tr></table>") == ("structured", ["Colonna 1", "Colonna 2"], [["a / c", "b"]])
    assert read("<table><tr><td colspan=x>only</td></tr>") == ("structured", ["Colonna 1"], [["only"]])
    assert read("<table><tr><td> </td></tr></table> rest")[0] == "fallback"


def test_serialized_rows(spark):
    rows = [("d", "t1", 4, "M", [], None, "Cap", "|h|\n|---|\n|v|\n|w|"), ("d", "t2", 5, "", ["A ", None, "B"], "G", "Cap", "prose"), ("d", "t3", 6, "M", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, element_id string, page int, manual_title string, path array<string>, caption_generated string, caption_original string, table_markdown string")
    got = {(r.element_id, r.row_id): (r.status, r.serialized_text) for r in tables.serialize_tables(df).collect()}
    assert got[("t1", "t1-row-0002")] == ("structured", "Manuale: M\nPercorso capitolo: Radice\nPagina PDF: 4\nTabella: t1\nDescrizione tabella: Cap\nRiga: 2\nh: w")
    assert got[("t2", "t2-row-0001")] == ("fallback", "Manuale: non disponibile\nPercorso capitolo: A > B\nPagina PDF: 5\nTabella: t2\nDescrizione tabella: G\nRiga: 1\nContenuto: prose")
    assert got[("t3", None)] == ("unavailable", None) and len(got) == 4


def test_caption_contract(spark):
    def cap(kind="sicurezza", seen="vite", values="uno", doubt="nessuna", sep="\n"):
        return sep.join(f"{k}: {v}" for k, v in zip(captions.LABELS, [kind, "leva", seen, "tiene", values, "alta", doubt], strict=True))

    bad = [None, "", cap(kind="foto"), cap(values=""), cap().replace("Oggetto: leva\n", ""), cap() + "\nextra", cap() + "\nOggetto: due"]
    assert one(spark, captions.canonical_caption, bad) == [None] * len(bad)
    assert one(spark, captions.canonical_caption, ["\n" + cap(kind=" UI/hmi", sep="\r\n\n"), cap(kind="Wiring  x")]) == [cap(kind="UI/HMI"), cap(kind="schema elettrico")]
    long = cap(values="u" * 1300)
    assert one(spark, lambda c: captions.canonical_caption(c, F.lit("technical-caption-v3")), [long, cap()]) == [None, cap()]
    cases = [cap(), cap(kind="schema elettrico"), cap(kind="schema/diagramma", seen="un cablaggio"), cap(kind="sicurezza", seen="un cablaggio"), cap(values="non leggibile"), cap(values="non leggibile", doubt="una")]
    assert one(spark, captions.review_reason, cases) == [None, captions.ELECTRICAL, captions.ELECTRICAL, None, captions.UNCERTAIN, None]


def test_paths_and_anchors(spark):
    c = spark.createDataFrame([("a", i, lv, t) for i, (lv, t) in enumerate([(1, "x"), (3, "y"), (2, "z"), (2, "w"), (1, "v")])], "doc_id string, ord int, level int, title string")
    got = [(r.path, r.ancestors) for r in tree.chapter_paths(c).orderBy("ord").collect()]
    assert got == [(["x"], []), (["x", "y"], [0]), (["x", "z"], [0]), (["x", "w"], [0]), (["v"], [])]
    assert tree.chapter_paths(c.limit(0)).count() == 0
    paths = spark.createDataFrame([("a", "m", "run.json"), ("a", "n", "out"), ("a", "o", "out/x.json"), ("a", "p", "output"), ("b", "q", "out")], "doc_id string, name string, path string")
    assert [tuple(r) for r in bundle.path_collisions(paths).collect()] == [("a", "n", "o")]


def test_match_headings(spark):
    import difflib

    rng = random.Random(9)
    words = ["1.2", "1", "Pumps", "Valves", "cold", "Water", "II.", "Oil"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    rows = [("a", i, title(), rng.choice([None, *range(1, 30)])) for i in range(30)]
    heads = [("a", i, title(), rng.randrange(1, 40), rng.choice([0.5, 0.75])) for i in range(25)]
    fold = lambda t: " ".join(re.sub(r"[^\w]+", " ", t.casefold()).split())
    mark = lambda t: (re.match(r"(\d+(?:\.\d+)*|[IVXLCDM]+\.)(?=\s|$)", t) or [""])[0]

    def score(t, p, h):
        a, b, x, y = fold(t), fold(h[2]), mark(t), mark(h[2])
        near = 0.0 if p is None else max(0.0, 1 - abs(h[3] - p) / 4)
        number = 0.0 if not x or not y else 1.0 if x == y else 0.6 if x.startswith(y) or y.startswith(x) else 0.0
        return min(1.0, difflib.SequenceMatcher(None, a, b).ratio() * 0.55 + near * 0.2 + number * 0.15 + h[4] * 0.1 + 0.08 * (a == b))

    want = {}
    for _, i, t, p in rows:
        close = [h for h in heads if p is not None and abs(h[3] - p) <= 3]
        best = max(close or heads, key=lambda h: (score(t, p, h), -h[1]))
        want[i] = (best[1], round(score(t, p, best), 9))
    r = spark.createDataFrame(rows, "doc_id string, index int, title string, resolved_page int")
    h = spark.createDataFrame(heads, "doc_id string, index int, title string, page int, confidence double")
    assert {m["index"]: (m.heading_index, round(m.score, 9)) for m in printed.match_headings(r, h).select("heading_index", "score", F.col("index").alias("i")).withColumnRenamed("i", "index").collect()} == want
