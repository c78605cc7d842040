"""Line dedup by winnowing over line hashes, then over words; DataFrame functions only.

A gram is ``GRAM`` lines in a row; of every ``WINDOW`` grams in a row the one with the least hash is a
fingerprint, so that any run of GRAM + WINDOW - 1 lines that two places share has a common one. Grams and
single lines of ``LONG_WORDS`` words are fingerprints too. Each fingerprint is joined to its first place in
the corpus (by id, then text hash, then line) and the match is extended both ways: by the line before and
the line after, each wherever the fingerprint stands first together with that line. What lies further off
has a fingerprint of its own. A later place is deleted where it is extended, or has ``LONG_WORDS`` words.

So of lines this is guaranteed: every run of three lines or more, and every run of one or two lines with 50
words together, that stands at an earlier place as a whole is deleted; shorter runs stay. A line is only
deleted as the copy of a line at an earlier place, so the first of all copies stays. Blank lines are part
of a run, but are never deleted before a line that stays.

What then stays is winnowed once more by words, without regard to lines: of every ``WORD_WINDOW`` words in a row
the one with the least hash begins a gram of ``WORD_GRAM`` words, and any run of ``LONG_WORDS`` words that
two places share has a common gram. Grams are joined to their first place, those that touch are one
match, whichever places they stand at, and its ends are extended word by word beside the places of its first
and last gram, which takes WORD_WINDOW - 1 words of either text. Of the later place the shared words are cut,
with the white space before each, where they are ``LONG_WORDS`` or more. Each end is paired with the first place
of its gram only: where that place shares fewer words than a later one does, up to WORD_WINDOW - 1 words of the
longer match stay at that end.

All of it is rows of bounded size: documents are numbered in their order, so that a place is one number; a
fingerprint's copies all point to one place, a match holds 24 words about each end, and intervals are merged
by windows over a document's rows, so that work grows with the lines and words, also where they are all alike.
Texts are dealt out once, by key and text hash, and stand in buckets from then on. Copies of a whole text are one text until the end. Numbers hold 2^36 documents of up to 2^27 lines and words.

Defined cases: null is a text without lines and stays null; lines are compared without white space at
their ends; rows equal in id and text are one document and all get its result; a null id comes
first; an empty table gives no rows; columns beside id and text pass through and are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.llm.common import SPACE, WORD, cut, dealt, shuffles

GRAM, WINDOW, LONG_WORDS = 2, 2, 50
#: Their sum less one is LONG_WORDS.
WORD_GRAM, WORD_WINDOW = 26, 25
#: The share of words that are told first as candidates of a window's least, and how often they are thinned at most.
#: Neither decides what is found: more rounds only leave fewer fingerprints.
OFTEN, ROUNDS = 1 / 7, 4
_BITS = 27
#: A document in the input: hashes of id and text.
_DOC = ("_key", "_th")


def _key(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit("document"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numbered(docs: DataFrame) -> DataFrame:
    """(_key, _th, _o, _copy) of documents (_id, _key, _th): numbers in the order of id and text hash, without gaps,
    and whether an earlier document has the same text.

    Range partitions are counted, and only the counts meet in one place.
    """
    order = [F.col("_id").asc_nulls_first(), F.col("_th").asc()]
    own = cut(docs.select("_id", *_DOC).distinct())
    own = cut(own.repartitionByRange(*order).sortWithinPartitions(*order).select(*_DOC, F.monotonically_increasing_id().alias("_m")))
    part = F.shiftright("_m", 33)
    parts = own.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.select("_p", (F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_from"))
    own = own.withColumn("_p", part).join(F.broadcast(parts), "_p").select(*_DOC, (F.col("_from") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("_o"))
    first = own.groupBy("_th").agg(F.min("_o").alias("_f"))
    return cut(own.join(first, "_th").select(*_DOC, "_o", (F.col("_o") != F.col("_f")).alias("_copy")))


def _place(o: str, pos: str) -> Column:
    return F.shiftleft(F.col(o), _BITS).bitwiseOR(F.col(pos).cast("long"))


def _doc(place: Column) -> Column:
    return F.shiftright(place, _BITS)


def _pos(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def _earlier(marks: DataFrame, apart: Column) -> DataFrame:
    """``marks`` (_k, _at, ...) whose key stands at an earlier place _s that does not overlap."""
    first = marks.groupBy("_k").agg(F.min("_at").alias("_s"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("_k").alias("_key"), "_s")
    return marks.join(first, F.col("_k") == F.col("_key")).filter(F.col("_at") - F.col("_s") >= apart).drop("_key")


def _merged(rows: DataFrame) -> DataFrame:
    """(_o, first, last): the intervals of a document, those that overlap or touch as one."""
    rows = rows.groupBy("_o", "first").agg(F.max("last").alias("last"))
    order = W.partitionBy("_o").orderBy("first")
    rows = rows.withColumn("_reach", F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_run", F.count(F.when(F.col("_reach").isNull() | (F.col("first") > F.col("_reach") + 1), 1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("_o", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def _by_document(runs: DataFrame) -> DataFrame:
    return runs.groupBy("_o").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


# --- lines -----------------------------------------------------------------------------------


def line_hashes(docs: DataFrame) -> DataFrame:
    """(_key, _th, _h, _n): the hashes and word counts of each document's lines."""

    text = F.col("_text")
    rare = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\f")
    # no line has more than single spaces between words
    plain = ~(rare | text.contains("  ") | text.contains(" \n") | text.contains("\n ") | text.startswith(" ") | text.endswith(" "))
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))

    def line(x: Column) -> Column:
        # single spaces between words are counted as bytes, all else by a regular expression
        odd = F.col("_rare") | x.startswith(" ") | x.endswith(" ") | x.contains("  ")
        n = F.when(x == "", 0).when(F.col("_plain") | ~odd, spaces(x) + 1).otherwise(F.regexp_count(x, F.lit(WORD)))
        h = F.when(F.col("_plain"), F.xxhash64(x)).otherwise(F.xxhash64(F.btrim(x, F.lit(" \t\x0b\f\r"))))
        return F.struct(h.alias("h"), n.alias("n"))

    docs = docs.filter(text.isNotNull()).select(*_DOC, "_text", plain.alias("_plain"), rare.alias("_rare")).select(*_DOC, F.transform(F.split("_text", "\n", -1), line).alias("_l"))
    return docs.select(*_DOC, F.col("_l.h").alias("_h"), F.col("_l.n").alias("_n"))


def line_marks(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(_o, pos, size, hash, long, before, after): the fingerprints of documents (_o, _h, _n), and the hashes of the lines about them."""
    h, n = F.col("_h"), F.col("_n")
    gram = F.transform(h, lambda x, i: F.when(F.get(h, i + 1).isNotNull(), F.xxhash64(x, F.get(h, i + 1))))
    rows = _let(gram, lambda g: F.transform(h, lambda x, i: F.struct(
        x.alias("h"), F.get(n, i).alias("n"), F.get(g, i).alias("g"), F.get(h, i - 1).alias("h0"), F.get(h, i + 1).alias("h1"), F.get(h, i + 2).alias("h2"),
        F.get(n, i + 1).alias("n1"), F.get(g, i - 1).alias("g0"), F.get(g, i + 1).alias("g1"),
    )))
    rows = docs.select("_o", F.posexplode(rows).alias("pos", "_r")).select("_o", "pos", "_r.*")
    long, longs = F.col("n") >= long_words, F.col("n") + F.coalesce("n1", F.lit(0)) >= long_words
    # the least of a window of two grams: the first of equals; a gram without neighbours is its own window
    least = (F.col("g") <= F.col("g1")) | (F.col("g") < F.col("g0")) | (F.col("g0").isNull() & F.col("g1").isNull())
    two = F.when(F.col("g").isNotNull() & (F.coalesce(least, F.lit(False)) | longs), F.struct(F.lit(2).alias("size"), F.col("g").alias("hash"), longs.alias("long"), F.col("h0").alias("before"), F.col("h2").alias("after")))
    one = F.when(long, F.struct(F.lit(1).alias("size"), F.col("h").alias("hash"), F.lit(True).alias("long"), F.col("h0").alias("before"), F.col("h1").alias("after")))
    return rows.select("_o", "pos", F.explode(F.filter(F.array(two, one), lambda m: m.isNotNull())).alias("_m")).select("_o", "pos", "_m.*")


def repeated_runs(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(_o, runs): for each document (_o, _h, _n) with repeated lines, the runs (first, last) of 0-based lines to delete."""
    marks = line_marks(docs, long_words)
    often = marks.groupBy("hash").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("hash").alias("_often"))
    marks = marks.join(often, F.col("hash") == F.col("_often"), "left_semi")
    # a fingerprint by itself where it is long, and with the line before and the line after it
    key = lambda kind, *of: F.xxhash64(F.lit(kind), F.col("size"), F.col("hash"), *of)
    run = lambda when, k, lo, n: F.when(when, F.struct(k.alias("_k"), lo.alias("lo"), n.alias("n")))
    zero, two = F.lit(0), F.col("size") == GRAM
    kinds = F.array(run(F.col("long"), key(0), zero, F.col("size")), run(two & F.col("before").isNotNull(), key(1, F.col("before")), F.lit(-1), F.col("size") + 1), run(two & F.col("after").isNotNull(), key(2, F.col("after")), zero, F.col("size") + 1))
    keys = marks.select("_o", "pos", F.explode(F.filter(kinds, lambda r: r.isNotNull())).alias("_r")).select("_r._k", _place("_o", "pos").alias("_at"), "_r.lo", "_r.n")
    found = _earlier(cut(keys), F.col("n"))
    runs = found.select(_doc(F.col("_at")).alias("_o"), (_pos(F.col("_at")) + F.col("lo")).alias("first"), (_pos(F.col("_at")) + F.col("lo") + F.col("n") - 1).alias("last"))
    return _by_document(_merged(runs))


# --- words -----------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    """The words of a text; only rare white space needs a regular expression."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\f")
    some = lambda s: F.filter(F.split(F.replace(s, F.lit("  "), F.lit(" ")), " ", -1), lambda x: x != "")
    plain = _let(F.replace(text, F.lit("\n"), F.lit(" ")), lambda s: F.when(s.startswith(" ") | s.endswith(" ") | (s == "") | s.contains("  "), some(s)).otherwise(F.split(s, " ", -1)))
    return F.when(odd, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).otherwise(plain)


def word_marks(texts: DataFrame, gram: int = WORD_GRAM, window: int = WORD_WINDOW, often: float = OFTEN) -> DataFrame:
    """(_o, _f): the places and hashes of the grams of words that are fingerprints, for documents (_o, _text).

    The words of low hash, a share of ``often``, are told first. Wherever a window has one, its least word is among
    them; only windows without one, which lie in the gaps between them, are looked through word by word.
    """
    low, lowest = (1 << _BITS) - 1, -(1 << 63)
    place = lambda v: v.bitwiseAND(F.lit(low))

    def least(values: Column, width: int = 1) -> Column:
        """The least of each window, by doubling."""
        if width == window:
            return values
        step = min(width, window - width)
        pairs = lambda v: F.zip_with(F.slice(v, 1, F.greatest(F.lit(0), F.size(v) - step)), F.slice(v, step + 1, F.size(v)), lambda a, b: F.least(a, b))
        return least(_let(values, pairs), width + step)

    def thinned(some: Column, rounds: int = ROUNDS) -> Column:
        """``some`` without those that are greater than both neighbours, where these lie within one window's reach.

        The least of a window is never one of them, and no gap of a window's length comes to be.
        """
        if not rounds:
            return some

        def thin(c: Column) -> Column:
            high = lambda x, i: (x > F.get(c, i - 1)) & (x > F.get(c, i + 1)) & (place(F.get(c, i + 1)) - place(F.get(c, i - 1)) <= window)
            # an edge lacks a neighbour and stays
            return _let(F.filter(c, lambda x, i: F.coalesce(~high(x, i), F.lit(True))), lambda d: F.when(F.size(d) == F.size(c), d).otherwise(thinned(d, rounds - 1)))

        return _let(some, thin)

    def between(placed: Column, some: Column) -> Column:
        """The least of each window in the gaps between ``some``."""
        gap = lambda a, b: F.when(b - a > window, F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
        gaps = F.filter(F.transform(some, lambda x, i: gap(place(x), place(F.get(some, i + 1)))), lambda g: g.isNotNull())
        return F.flatten(F.transform(gaps, lambda g: F.transform(F.array_distinct(least(F.slice(placed, g["a"] + 1, g["b"] - g["a"] - 1))), lambda v: v + 1)))

    def marks(words: Column) -> Column:
        # a word's hash above its place: the least of a window tells where it stands, the first of equals
        placed = F.transform(words, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~low)).bitwiseOR(i))
        last = F.greatest(F.lit(0), F.size(words) - gram + 1)
        seldom = lambda v: F.filter(v, lambda x: (x <= min(lowest + int(often * (1 << 64)), -lowest - 1)) & (place(x) < last))
        # places from 1, and an edge before the first and after the last
        edged = lambda v: F.concat(F.array(F.lit(lowest)), F.transform(seldom(v), lambda x: x + 1), F.array(F.lit(lowest).bitwiseOR(last + 1)))
        told = _let(placed, lambda v: _let(thinned(edged(v)), lambda c: F.concat(F.filter(c, lambda x: x > lowest + low), between(v, c))))
        return F.transform(told, lambda v: F.struct((place(v) - 1).cast("int").alias("pos"), F.xxhash64(F.slice(words, place(v).cast("int"), F.lit(gram))).alias("hash")))

    texts = texts.filter(F.octet_length("_text") >= 2 * (gram + window) - 3)
    return texts.select("_o", _let(words_of(F.col("_text")), marks).alias("_f"))


def _equal(a: Column, b: Column) -> Column:
    """The number of equal values that two arrays begin with."""

    def same(n: Column) -> Column:
        differ = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
        return F.when(differ == 0, n).otherwise(differ - 1).cast("int")

    return _let(F.least(F.size(a), F.size(b)), same)


def repeated_spans(docs: DataFrame, *, gram: int = WORD_GRAM, window: int = WORD_WINDOW) -> DataFrame:
    """(_o, runs) for documents (_key, _th, _o, _text), dealt by key and text hash: the runs (first, last) of gram + window - 1 words or more to cut, by 0-based words."""
    around, least = window - 1, gram + window - 1
    marks = cut(word_marks(docs, gram, window)).select("_o", F.explode("_f").alias("_f")).select(F.col("_f.hash").alias("_k"), F.shiftleft("_o", _BITS).bitwiseOR(F.col("_f.pos").cast("long")).alias("_at"))
    pairs = _earlier(marks, F.lit(gram)).groupBy("_at").agg(F.min("_s").alias("_s"))
    pairs = pairs.select(_doc(F.col("_at")).alias("_o"), _pos(F.col("_at")).alias("pos"), "_s")
    # grams that touch are one match, whichever places they stand at first; its ends go by their own grams
    order = W.partitionBy("_o").orderBy("pos")
    pairs = pairs.withColumns({"_new": F.coalesce(F.col("pos") - F.lag("pos").over(order) > gram, F.lit(True)), "_end": F.coalesce(F.lead("pos").over(order) - F.col("pos") > gram, F.lit(True))}).filter("_new or _end")
    # what is left are the first and the last gram of each match, one row where they are one
    runs = pairs.withColumns({"_to": F.when(F.col("_end"), F.col("pos")).otherwise(F.lead("pos").over(order)), "_e": F.when(F.col("_end"), F.col("_s")).otherwise(F.lead("_s").over(order))})
    runs = cut(runs.filter("_new").select("_o", F.col("pos").alias("_at"), "_to", "_s", "_e"))

    # each match asks its own text and those of its two first places for the words about its ends; only such texts are read
    run = F.shiftleft("_o", _BITS).bitwiseOR(F.col("_at").cast("long"))
    ask = lambda kind, of, lo, hi: F.struct(F.lit(kind).alias("kind"), of.alias("_w"), lo.alias("lo"), hi.alias("hi"))
    asks = F.array(ask(0, F.col("_o"), F.col("_at"), F.col("_to")), ask(1, _doc(F.col("_s")), _pos(F.col("_s")), _pos(F.col("_s"))), ask(2, _doc(F.col("_e")), _pos(F.col("_e")), _pos(F.col("_e"))))
    asks = cut(runs.select(run.alias("_run"), "_to", F.explode(asks).alias("_q")).select("_run", "_to", "_q.*"))
    ends = docs.select(*_DOC, "_o").join(asks.select("_w").distinct(), F.col("_o") == F.col("_w"), "left_semi").select(*_DOC)
    own = docs.join(cut(ends).hint("shuffle_hash"), list(_DOC), "left_semi").select("_o", words_of(F.col("_text")).alias("_p"))
    none = F.array().cast("array<string>")
    start = F.greatest(F.lit(0), F.col("lo") - around)
    told = own.join(asks, F.col("_o") == F.col("_w")).select(
        "_run", "_to", "kind", F.when(F.col("kind") < 2, F.reverse(F.slice("_p", start + 1, F.col("lo") - start))).otherwise(none).alias("a"), F.when(F.col("kind") != 1, F.slice("_p", F.col("hi") + gram + 1, F.lit(around))).otherwise(none).alias("b"),
    )
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    told = told.groupBy("_run", "_to").agg(of(0, "a").alias("a"), of(0, "b").alias("b"), of(1, "a").alias("sa"), of(2, "b").alias("sb"))
    found = told.select(_doc(F.col("_run")).alias("_o"), (_pos(F.col("_run")) - _equal(F.col("a"), F.col("sa"))).alias("first"), (F.col("_to") + gram - 1 + _equal(F.col("b"), F.col("sb"))).alias("last"))
    return cut(_by_document(_merged(found.filter(F.col("last") - F.col("first") + 1 >= least))))


# --- texts -----------------------------------------------------------------------------------


def _between(pieces: Column, runs: Column) -> Column:
    """The pieces outside of the sorted, separate runs, in linear time."""

    def stay(pieces: Column) -> Column:
        ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(pieces)))
        begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
        return F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(pieces, b + 1, e - b)))

    return _let(pieces, stay)


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    """All rows and columns of ``df``, the text without its later repeated runs, and __n_lines, __n_removed, __runs.

    __n_words_removed and __spans tell the same of the words that are cut from what stays; they count its words from 0.
    Columns of the input with one of these five names are replaced.
    """
    told = ("__n_lines", "__n_removed", "__runs", "__n_words_removed", "__spans")
    rest = [c for c in df.columns if c not in (id_col, text_col, *told)]
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(c) for c in rest)).alias("_rest") if rest else F.lit(0).alias("_rest"), _key(id_col).alias("_key"), F.xxhash64(text_col).alias("_th"))
    numbers = numbered(base.filter(F.col("_text").isNotNull()).select("_id", *_DOC))
    firsts = line_hashes(base).join(numbers.filter("not _copy"), list(_DOC)).groupBy("_o").agg(F.first("_h").alias("_h"), F.first("_n").alias("_n"))
    runs = repeated_runs(cut(firsts), long_words).withColumnRenamed("runs", "_runs")
    # texts are dealt out once, here; what is found later comes to them
    out = base.repartition(shuffles(df.sparkSession), *_DOC).join(numbers.join(runs, "_o", "left"), list(_DOC), "left")
    n = F.coalesce(F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("int")
    # a copy of a text is a run as a whole
    whole = F.col("_copy") & ((n > GRAM + WINDOW - 2) | (F.regexp_count("_text", F.lit(WORD)) >= long_words))
    out = out.withColumn("_runs", F.when(whole, F.array(F.struct(F.lit(0).alias("first"), (n - 1).alias("last")))).otherwise(F.col("_runs")))
    gone = F.coalesce(F.aggregate("_runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0)).cast("long")
    text = F.when(whole, "").when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join(_between(F.split("_text", "\n", -1), F.col("_runs")), "\n"))
    out = dealt(out.select(*_DOC, "_id", "_o", "_copy", "_rest", text.alias("_text"), n.cast("long").alias("_n"), gone.alias("_gone"), "_runs"), *_DOC)

    spans = repeated_spans(out.filter("not _copy").select(*_DOC, "_o", "_text")).join(numbers.drop("_copy"), "_o").select(*_DOC, F.col("runs").alias("_spans"))
    out = out.join(spans.hint("shuffle_hash"), list(_DOC), "left")
    # each word with the white space before it
    words = F.regexp_extract_all("_text", F.lit(f"[{SPACE}]*+{WORD}+|[{SPACE}]++$"), F.lit(0))
    text = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.array_join(_between(words, F.col("_spans")), ""))
    gone = F.coalesce(F.aggregate("_spans", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0)).cast("long")
    kept = {id_col: F.col("_id"), text_col: text}
    kept |= {c: F.col("_rest")[c] for c in rest}
    return out.select(*(kept[c].alias(c) for c in df.columns if c not in told), F.col("_n").alias("__n_lines"), F.col("_gone").alias("__n_removed"), F.col("_runs").alias("__runs"), gone.alias("__n_words_removed"), F.col("_spans").alias("__spans"))
