"""Operators that SQL cannot express, against plain loops on small fixtures."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docgrid.llm import langid, line_dedup, pii


def test_disclosing_terms(spark):
    """Terms of whole texts by their disclosure, repeated rows and null ids counted as any row."""
    rng = np.random.default_rng(4)
    terms = [f"{a}{b}word" for a in "abcdefgh" for b in "klmn"]
    rows = []
    for i in range(70):
        text = " ".join(rng.choice(terms, 12))
        if i % 4 == 0:
            text += f" mail{i % 3}@site.com"
        if i % 7 == 0:
            text = f"+49 30 1234{i % 2}67 " + text + " only" + "ab"[i % 2] + "term"
        rows.append((None if i % 10 == 3 else i, text))
    rows += rows[:9] + [(900, None), (901, "")]
    n = len(rows)
    found = []
    for _, text in rows:
        text = text or ""
        entities = {("email", m.group().lower()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)} | {("phone", m.group().lower()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text)}
        found.append((text, entities, {w.lower() for w in re.findall(r"[^\W\d_]{3,}", text)}))
    df_t, df_e, df_te = Counter(), Counter(), Counter()
    for _, entities, words in found:
        df_t.update(words)
        df_e.update(entities)
        df_te.update((t, e) for t in words for e in entities)
    telling = defaultdict(set)
    for (t, e), both in df_te.items():
        given, content = (both + 0.5 * df_e[e] / n) / (df_t[t] + 0.5), -math.log(df_e[e] / n)
        if content > 0 and math.log(given * n / df_e[e]) >= 0.9 * content:
            telling[e].add(t)
    want = []
    for (key, _), (text, entities, _) in zip(rows, found, strict=True):
        spans = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+[0-9][ ().0-9-]+[0-9]", text)]
        out = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", text) if any(m.group().lower() in telling[e] for e in entities) and not any(m.start() < b and m.end() > a for a, b in spans)]
        want.append((-1 if key is None else key, ",".join(out)))
    got = pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = [(-1 if r["doc_id"] is None else r["doc_id"], ",".join(s for s in r["spans"].split(",") if s.startswith("term"))) for r in got]
    assert any(w for _, w in want) and sorted(own) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_lines(spark, seed):
    """Of lines just those go that stand in three lines which an earlier, separate place has too."""
    rng = np.random.default_rng(seed)
    docs = [(None if i == 7 else i, "\n".join(f"w{k} x" for k in rng.integers(0, 4 if i % 2 else 9, rng.integers(1, 22)))) for i in range(40)]
    docs += docs[:3]
    distinct = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    first: dict[tuple, tuple[int, int]] = {}
    lines = [text.split("\n") for _, text in distinct]
    for d, own in enumerate(lines):
        for p in range(len(own) - 2):
            first.setdefault(tuple(own[p : p + 3]), (d, p))
    want = {}
    for d, (key, text) in enumerate(distinct):
        gone = set()
        for p in range(len(lines[d]) - 2):
            at = first[tuple(lines[d][p : p + 3])]
            if at[0] != d or p - at[1] >= 3:
                gone |= {p, p + 1, p + 2}
        want[key, text] = "\n".join(x for k, x in enumerate(lines[d]) if k not in gone)
    got = line_dedup.dedup_lines(spark.createDataFrame([(k, t, t) for k, t in docs], "doc_id long, text string, original string")).collect()
    assert len(got) == len(docs)
    assert {(r["doc_id"], r["original"]): r["text"] for r in got} == want


@pytest.mark.parametrize("often", [0.0, 1 / 7, 1.0])
def test_least_words_of_windows(spark, often):
    """Each window's least word begins a fingerprint, whatever share of words is told first, and few others do."""
    import xxhash

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, most, n)) for most in (1, 2, 9, 500) for n in (40, 49, 50, 51, 75, 400)]
    texts += [t.replace("w1", "\n w1\t") for t in texts[-8:]] + [t.replace(" ", "   \n") for t in texts[-3:]]
    df = spark.createDataFrame(list(enumerate(texts)), "_o long, _text string")
    got = {r["_o"]: [m["pos"] for m in r["_f"]] for r in line_dedup.word_marks(df, often=often).collect()}
    want_all, got_all = 0, 0
    for d, text in enumerate(texts):
        w = text.split()
        h = [(((xxhash.xxh64(x.encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64)) >> 27, p) for p, x in enumerate(w[: max(0, len(w) - 25)])]
        want = {min(h[s : s + 25])[1] for s in range(len(h) - 24)}
        own = got.get(d, [])
        assert len(own) == len(set(own)) and want <= set(own) and all(0 <= p < len(h) for p in own)
        want_all, got_all = want_all + len(want), got_all + len(own)
    assert got_all < (4 if often == 1 else 1.5) * want_all


def test_held_out_accuracy(spark):
    """Languages of documents that were not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pred = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(pred) > 20 and sum(r["lang"] == r["lang_pred"] for r in pred) >= 0.97 * len(pred)


def test_pipeline(spark, tmp_path):
    """Each stage's decision on planted rows: letterless, near copies, a benchmark passage; the mix keeps to its targets."""
    import corpus_pipeline

    rng = np.random.default_rng(2)
    word = lambda lang: "".join(rng.choice(list("aeiou" if lang == "en" else "zxkwq")) + rng.choice(list("tns" if lang == "en" else "bgp")) for _ in range(3))
    text = lambda lang, n=60: " ".join(word(lang) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "fr"), "en" if i % 2 else "fr", "abc"[i % 3]) for i in range(60)]
    copy, item = rows[5][1], text("en", 40)
    rows += [(100, "123 !!", "en", "a"), (101, None, "en", "a"), (102, copy, "en", "a"), (103, copy + " end", "en", "b"), (104, f"{text('en', 9)} {item}", "en", "c"), (None, text("fr"), "fr", "c")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, text("fr", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = {i for i in range(60)} | {None}
    assert {r["doc_id"] for r in out} <= clean and set(docs.columns) <= set(out[0].asDict()) and {r["shard"] for r in out} <= set(range(8))
    kept = [r for r in rows if r[0] in clean]
    size = Counter()
    for _, t, _, s in kept:
        size[s] += len(t.split())
    words = Counter()
    for r in out:
        words[r["source"]] += len(r["text"].split())
    target, weights, left = {}, dict(zip("abc", (3, 1, 2), strict=True)), 1.5 * sum(size.values())
    while over := [s for s in weights if left * weights[s] / sum(weights.values()) > 2 * size[s]]:
        target |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        weights = {s: w for s, w in weights.items() if s not in over}
    target |= {s: left * w / sum(weights.values()) for s, w in weights.items()}
    assert all(abs(words[s] - t) <= 70 for s, t in target.items())
