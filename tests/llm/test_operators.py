"""Edge cases and brute-force parity of the ten operators on small fixtures."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from docgrid.llm import decontam, exact_dedup, html_text, langid, licenses, line_dedup, mixing, near_dedup, pii, sharding
from docgrid.llm.common import shingle_hashes, word_hashes

KIND = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string"
WORDS = [f"w{i:03d}" for i in range(400)]


def words(a, n=60):
    return " ".join(WORDS[(a * 37 + k * (a % 7 + 1)) % 400] for k in range(n))


ROWS = [
    (1, words(1), "en", "a", 1, "x", "y"),
    (2, words(1) + " ", "en", "a", 1, "x", "y"),
    (3, None, None, None, None, None, None),
    (4, "", "fr", "b", 0, None, None),
    (5, "a" * 200_000, "fr", "b", 0, None, None),
    (6, words(2).replace("w", "é"), "fr", None, 0, None, None),
    (6, words(2).replace("w", "é"), "fr", None, 0, None, None),
    (None, words(3), "en", "b", 1, None, None),
    (7, words(1) + " tail", "en", "c", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert mixing.plan_mix(empty).count() == 0
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert decontam.contaminated(empty, bench).count() == 0
    assert pii.pii_report(empty).count() == 0
    assert near_dedup.near_duplicates(empty)[0].count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0


def test_mix(docs):
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(ROWS)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert set(mixing.mix_documents(docs).columns) == set(docs.columns)


def test_mix_keeps_repeated_rows(spark):
    """Words of the mix come to each source's target within one document, also where rows are equal or share an id."""
    rows = [(1, "w " * 10, "a", 0)] * 10 + [(2, "w " * (k % 7), "b", 0) for k in range(30)] + [(None, "w " * 9, None, k) for k in range(12)] + [(k, "w w", "c", k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan, words = {}, {}
    for r in mixing.plan_mix(df).collect():
        plan[r["source"]] = r["target"]
    for r in mixing.mix_documents(df).collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(words[s] - t) < 11 for s, t in plan.items())


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 1.0), (0.5, 3.0), (1.0, 0.5))
    done = spark.range(101).select((F.col("id") / 100.0).alias("s"), mixing.position(F.col("id") / F.lit(100.0), F.lit(0), (knots,)).alias("t")).collect()
    for r in done:
        t, area = r["t"], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            e = min(max(t - t0, 0), t1 - t0)
            area += e * w0 + (w1 - w0) / (t1 - t0) * e * e / 2
        assert area / mixing.integral(knots) == pytest.approx(r["s"], abs=1e-9)


def test_language(spark):
    rows = [(i, ("the cat and the dog with that " if i % 2 else "le chat et la maison pour nous ") * 3, "en" if i % 2 else "fr") for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.learn(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"


def test_features_in_pieces():
    text = ("ab  é cde " * 900).encode()
    assert np.array_equal(langid.features([text]), langid.features([text], 100))


def test_drop_exact_duplicates(spark):
    rows = [(1, "a b", 1), (1, "ab", 2), (1, "c", 3), (1, "c", 3), (None, "d", 4), (2, "a  b", 5), (3, None, 6), (3, "", 6)]
    got = exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string, sha int")).collect()
    assert sorted(r["text"] or "" for r in got) == ["", "a  b", "c", "d"]


def test_exact(docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["keep_id"] == 2 and by[2]["kept"] and by[1]["group_size"] == 2
    assert by[3]["keep_id"] == 3 and by[4]["group_size"] == 2
    assert by[1]["text_sha256"] == hashlib.sha256(re.sub(r"\s+", "", words(1)).encode()).hexdigest()


def test_exact_salted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 10)
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"own {i}") for i in range(90)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(df).collect()}
    assert all(got[i]["keep_id"] == (1 if i % 3 else i) and got[i]["group_size"] == (60 if i % 3 else 1) for i in range(90))


def test_licenses(spark):
    texts = ["Intro. Licensed under the Apache License, Version 2.0. More text", "This work is licensed under the GNU General Public License, version 3.\nOr (at your option) any later version.", "No rights here", "Some odd license of ours.", None, ""]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["licenses"] == "Apache-2.0" and got[1]["licenses"] == "GPL-3-or-later" and got[3]["n_unknown"] == 1
    assert set(got) == {0, 1, 3}


def tile_brute(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        out += n


def test_tiles_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 4, 30).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64)
        got = decontam.tiles(a, b, np.ones(len(b), bool), 5)
        assert sum(n for _, _, n in got) == tile_brute(a.tolist(), b.tolist(), 5)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)


def test_tiles_of_equal_words_are_linear():
    index = decontam.Index([(1, "w " * 20_000), (2, " ".join(f"t{i % 50}" for i in range(20_000)))])
    assert [(i, n, k) for _, i, n, k in decontam._given_away(index, [b"w " * 40_000], 0.8)] == [(0, 20_000, 1)]


def test_drop_contaminated(spark):
    bench = spark.createDataFrame([(1, words(4)), (2, words(6))], "item_id long, text string")
    rows = [(None, "x " + words(4), 1), (1, words(5), 2), (1, words(6), 3), (2, None, 4), (2, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    for block in (1, 1000):
        assert sorted(r["item_id"] for r in decontam.drop_contaminated(df, bench, block_tokens=block).collect()) == [2, 4, 5]


def test_decontaminate(spark, docs):
    item = words(1).split()
    bench = spark.createDataFrame([(10, " ".join(item[30:] + item[:30])), (11, words(9)), (12, None), (13, "é000")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert {(1, 10), (2, 10), (7, 10)} <= got and not any(i == 11 for _, i in got)
    assert got == {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, block_tokens=1).collect()}


def test_pii(spark):
    text = "Mail ann@site.example.com or +44 (0) 20 7946 0958, card 4111 1111 1111 1111, host 10.0.0.1 and 999.1.1.1; é x@y.z_q@r.st"
    df = spark.createDataFrame([(1, text), (2, None), (3, "a.b" * 60_000), (4, "1" * 30_000), (5, "a@b" + ".c" * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pii_report(df).collect()}
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [3, 1, 1, 1]
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"]
    spans = [f"email:{m.start()}:{m.end()}" for m in re.finditer(plain[0], text)]
    assert got[1]["spans"].split(",")[:3] == spans
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[5]["n_email"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, support=2).collect()}
    assert clean[1].startswith("Mail [EMAIL] or [PHONE], card [CARD], host [IP]") and clean[2] is None


def test_pii_terms(spark):
    rows = [(i, f"{WORDS[i % 400]} zebra ann@site.com common") for i in range(5)] + [(100 + i, f"{words(i)} common") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_term"] == 1 for i in range(5)) and not any(got[100 + i]["n_term"] for i in range(60))


def test_pii_terms_of_a_single_text(spark):
    """An entity of one text is protected as any other; a term that stands elsewhere more often is not removed."""
    rows = [(0, "common zebra ann@site.com"), (1, "common yak bob@site.com")] + [(100 + i, f"{words(i)} common" + " yak" * (i < 9)) for i in range(200)]
    got = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["spans"] == "email:13:25,term:7:12" and got[1]["n_term"] == 0 and not any(got[100 + i]["n_term"] for i in range(200))


def test_pii_terms_of_whole_texts(spark):
    """A disclosing term is found at any distance from the entity, and marked wherever it stands; null ids count."""
    far = " common" * 60
    texts = [f"zebra{far} ann@site.com", f"ann@site.com zebra{far} Zebra", f"ann@site.com{far}{far} zebra"]
    rows = [*zip((1, None, 3), texts, strict=True)] + [(100 + i, f"{words(i)} common") for i in range(100)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in zip((1, None, 3), texts, strict=True):
        assert got[i].split(",")[1:] == [f"term:{m.start()}:{m.end()}" for m in re.finditer("zebra", text, re.I)]
    assert not any(got[100 + i] for i in range(100))


def test_near(spark, docs):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs)[0].collect()}
    assert got[1]["class_id"] == got[2]["class_id"] == got[7]["class_id"] == 1 and got[1]["class_size"] == 3
    assert got[3]["class_id"] == 3 and got[4]["class_id"] == 4 and got[None]["class_id"] is None
    assert set(near_dedup.drop_near_duplicates(docs).columns) == set(docs.columns)


def test_near_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base, texts = [rng.integers(0, 10**6, 150) for _ in range(12)], []
    for b in base:
        for _ in range(8):
            t = b.copy()
            t[rng.integers(0, 150, rng.integers(0, 9))] = rng.integers(0, 10**6)
            texts.append(" ".join(map(str, t)))
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0].collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(label))


def test_near_of_repeated_ids_and_rows(spark):
    """Null ids, several texts of one id, equal rows: one row of each group stays, and counts are of rows."""
    rows = [(None, words(1), 0), (None, words(1), 0), (4, words(1) + " x", 1), (4, words(2), 2), (4, words(2), 2), (9, words(3), 3), (None, words(9), 4), (5, None, 5), (5, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class int")
    got = sorted(((r["class_id"] or 0, r["class_size"], r["kept"]) for r in near_dedup.near_duplicates(df)[0].collect()))
    assert got == [(0, 1, True), (4, 2, True), (4, 2, True), (4, 3, False), (4, 3, False), (4, 3, True), (5, 1, True), (5, 1, True), (9, 1, True)]
    assert sorted(r["class"] for r in near_dedup.drop_near_duplicates(df).collect()) == [1, 2, 3, 4, 5, 5]
    links = near_dedup.near_duplicates(df)[1].collect()
    assert [(r["a"], r["b"]) for r in links] in ([(None, 4)], [(4, None)])


def test_near_of_buckets_of_many_blocks(spark, monkeypatch):
    """Buckets of many blocks lose no link: a chain in which each text is like its neighbours only."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 1)
    base = [f"v{i}" for i in range(120)]
    texts = [" ".join(base[: 120 - 4 * k] + [f"x{k}_{j}" for j in range(4 * k)]) for k in range(5)] * 8
    texts = [t + f" end{i}" for i, t in enumerate(texts)]
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0].collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(label))


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    el = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = rng.uniform(0.2, 9, 300), rng.uniform(0.2, 9, 300)
    y[:150] = x[:150]
    sig = near_dedup.dart_signatures(np.repeat([0, 1], 300), np.concatenate([el, el]), np.concatenate([x, y]), 2, 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.05)


def test_tokens():
    h, at = word_hashes(["Ab  cd\tab".encode(), b"", "ÉÀ éà".encode()])
    assert at.tolist() == [0, 3, 3, 5] and h[0] == h[2] and h[3] == h[4]
    assert len(shingle_hashes(h[:3])) == 1 and len(shingle_hashes(h[:0])) == 0


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies here</div><article><h1>Head &amp; line</h1><p>One <b>two</b>\n three.<p>Four<script>var a="</p>"</script> five</article><div id="comments"><p>First reader says a lot of things here</p></div><footer>&copy; x</footer></body></html>'
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text")], "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & line One two three. Four five" and got[2]["text"] == "" and got[4]["text"] == "unclosed text"


LONG = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen. " * 3


@pytest.mark.parametrize(
    ("page", "words"),
    [
        (f'<body><div class="text-widget"><h1>Head here</h1><p>{LONG}</p><p>{LONG}</p></div></body>', 86),
        (f'<body><nav><a>x</a></nav><div id="promotion-of-science-article"><p>{LONG}</p><p>Short one.</p></div></body>', 44),
        (f'<article><p>{LONG}</p><svg class="i"/><p>second {LONG}</p></article>', 85),
        (f"<article><p class=it's>text {LONG}</p><p>b</p></article>", 44),
        (f'<div class="content with-sidebar"><article><p>{LONG}</p></article><div class="sidebar"><p>{LONG}</p></div></div>', 42),
        (f'<form id="all"><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class="login">Sign in now</div></form>', 85),
        (f'<article><p>{LONG}</p><div class="ad">Buy this</div><p>{LONG}</p></article><div id="comments"><article class="comment"><p>{LONG}</p></article></div>', 84),
        (f"<ul><li><a>Home</a></li><li><a>About us</a></li></ul><h1>My title</h1><p>{LONG}</p><p>{LONG}</p><p><a>Prev page of it all</a></p><p>{LONG}</p>", 128),
        (f"<article><noscript>on<p>{LONG}</p></article>", 43),
        (f"<article><p>{LONG}</p><script>var a = '<p>';", 42),
        ("<p " * 50_000, 0),
        ("<div>" * 20_000 + "deep " + "</div>" * 20_000, 1),
    ],
)
def test_main_text_of_layouts(page, words):
    assert len(html_text.main_text(page, html_text.trained()).split()) == words


def test_lines(spark):
    block = "\n".join(f"line {k} of the block" for k in range(6))
    long = words(4, 55)
    df = spark.createDataFrame([(1, "own a\n" + block + "\nown b"), (2, "else\n" + block + "\nmore"), (3, None), (4, ""), (5, "x\n" + long), (6, long + "\ny"), (7, "z\n" * 9 + "z")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1]["text"] == "own a\n" + block + "\nown b" and got[2]["text"] == "else\nmore"
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "x\n" + long and got[6]["text"] == "y"
    assert got[7]["text"].split("\n")[:2] == ["z", "z"]


def test_long_runs_of_few_lines(spark):
    """Two shared lines of 50 words together go wherever they stand; the first of them stay."""
    a, b, c = words(3, 27), words(5, 23), words(6, 22)
    rows = [(10 * n + k, "\n".join([*(f"own {n} {k} {j}" for j in range(n)), a, other, f"end {n} {k}"])) for n in range(6) for k, other in enumerate((b, c))]
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(1, 6):
        assert a not in got[10 * n] and b not in got[10 * n] and len(got[10 * n]) == n + 1
    assert a in got[0] and b in got[0] and c in got[1]


def test_runs_whose_gram_stands_earlier(spark):
    """A run of three lines goes as a whole though an earlier document has two of them, and two lines though it has the long one."""
    rows, line = [], lambda *k: " ".join(f"v{'_'.join(map(str, k))}_{j}" for j in range(20))
    for t in range(40):
        x, y, z = (line(t, k) for k in range(3))
        rows += [(10 * t + 1, f"{y}\n{z}" if t % 2 else f"{x}\n{y}"), (10 * t + 2, f"a {t}\n{x}\n{y}\n{z}"), (10 * t + 3, f"b {t}\n{x}\n{y}\n{z}")]
    long = " ".join(line(90, k) for k in range(3))
    rows += [(901, long), (902, f"a\n{line(91)}\n{long}"), (903, f"b\n{line(91)}\n{long}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * t + 3] == f"b {t}" for t in range(40)) and got[903] == "b"


def test_passages_inside_lines(spark):
    """A passage of 50 words goes from the midst of a later document's line, also across lines; one of 49 stays."""
    a, b = words(4, 50), words(6, 49)
    wrapped = "\n".join((a[:80], a[81:])) if a[80] == " " else a.replace(" ", "\n", 20)
    rows = [(1, f"one {a} end"), (2, f"two {a} other"), (3, f"three x {wrapped} y"), (4, f"p {b} q"), (5, f"r {b} s"), (None, "null " + words(5, 70)), (6, "six " + words(5, 70) + " tail")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4, 5, None, 6)] == [rows[0][1], "two other", "three x y", rows[3][1], rows[4][1], rows[5][1], "six tail"]
    assert [got[k]["__n_words_removed"] for k in (1, 2, 3, 4, 6)] == [0, 50, 50, 0, 70]


def test_many_equal_lines_and_clashing_columns(spark):
    """One document of very many equal lines; input columns named as those made inside."""
    rows = [(1, "a line of five words\n" * 60_000, 1, 2, 3), (2, "en " * 30_000, 4, 5, 6), (2, None, 7, 8, 9)]
    got = {(r["doc_id"], r["_id"]): r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _id int, _th int, runs int")).collect()}
    assert got[1, 1]["text"] == "a line of five words\n" * 3 and (got[1, 1]["_th"], got[1, 1]["runs"]) == (2, 3)
    assert got[2, 4]["__n_words_removed"] > 29_000 and got[2, 7]["text"] is None


def test_shards(spark, docs):
    import xxhash

    got = sharding.assign_shards(docs, 8).collect()
    assert len(got) == len(ROWS)
    for r in got:
        score = lambda s: ((xxhash.xxh64(f"{'∅' if r['doc_id'] is None else r['doc_id']}#{s}".encode(), seed=42).intdigest() >> 11) + 0.5) / 2**53  # noqa: B023, E731
        assert r["shard"] == max(range(8), key=score) and r["grown_shard"] == max(range(9), key=score)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert next(r for r in got if r["doc_id"] == 1)["text_crc32"] == zlib.crc32(words(1).encode())


def test_written_shards(spark, docs, tmp_path):
    """All rows come back from the files, each from the shard that its key is dealt to."""
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    told = {(r["doc_id"], r["shard"]) for r in sharding.assign_shards(docs, 4).collect()}
    assert back.count() == len(ROWS) and {(r["doc_id"], r["shard"]) for r in back.collect()} == told
    assert "size" in back.columns


def test_texts_of_lines_are_dealt_once(spark):
    """What is found of a text comes to its bucket: no exchange of the last plan moves texts."""
    df = spark.createDataFrame([(i, f"one {i}\ntwo\nthree\nfour", i) for i in range(20)], "doc_id long, text string, other int")
    out = line_dedup.dedup_lines(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "Bucketed: true" in line]
    assert len(scan) == 1 and "_text" in scan[0] and not any("Exchange" in line and scan[0].index("FileScan") - line.index("Exchange") in (2, 3) for line in plan.split("\n") if "Exchange" in line)
    assert sorted((r.doc_id, r.other, r.text) for r in out.collect())[1] == (1, 1, "one 1")


@pytest.mark.parametrize("langs", [(None,), ("en", "fr")])
def test_language_stage_drops_no_text_with_letters(spark, langs):
    """Also where nothing is labelled, or the score is low, a text with a letter goes on, with its language."""
    texts = ["the cat and the dog are here", "le chat et le chien sont ici", "x", "zz qq", "7 !", None]
    docs = spark.createDataFrame([(i, t, langs[i % len(langs)]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.keep_identified(docs, model).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert all((got[i].lang_pred, got[i].score) == want[i] for i in got)
    assert langs != (None,) or {r.lang_pred for r in got.values()} == {"und"}
