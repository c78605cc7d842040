"""PII by information-theoretic sanitisation; DataFrame functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. For each
entity all words of the texts that mention it are terms that may reveal it. With frequencies of rows over
the whole corpus, a term's disclosure of an entity is its pointwise mutual information with it over
the entity's information content, ``log(p(t,e) / p(t) p(e)) / -log p(e)``: 1 when the term occurs
with that entity alone. Terms at or above the threshold that occur with the entity in enough
different texts are removed, the entities themselves are generalised to their kind.

The patterns have no nested repetition that Java's matcher would recurse over, and begin only where
a run of their characters begins, so that long texts cost linear time and constant stack.

Defined cases: null is the empty text; rows equal in id and text are found together and all
returned; entities of a single text have terms too; an empty table gives no rows; only id and
text are read. Offsets are code points from 0, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import cut, row_key

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The least disclosure, and the fewest different texts (1: no entity is left out).
DISCLOSURE, SUPPORT = 0.9, 1
#: Documents by which p(e|t) is drawn towards p(e).
PRIOR = 0.5
TERM = r"\p{L}{3,}"

SPAN = "array<struct<start:int,end:int,match:string>>"
PLACES = "array<struct<start:int,end:int>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """The places of all matches: what stands between them tells the offsets."""
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("p"), found.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pieces, zero, step)["out"]).otherwise(F.array().cast(SPAN))


def base_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, _text, spans): the valid matches of all kinds, each with its kind, in the kinds' order."""
    out = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    may = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+"))}
    none = F.array().cast("array<string>")
    out = out.withColumns({f"_m_{k}": F.when(may.get(k, F.lit(True)), F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})

    def valid(kind: str) -> Column:
        found = F.filter(_spans(F.col("_text"), F.col(f"_m_{kind}"), PATTERNS[kind]), lambda s: _valid(kind, s["match"]))
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))

    each = [valid(k) for k in KINDS]
    return out.select("_id", "_th", "_text", F.concat(*each).alias("spans"))


def _words(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _places(text: Column, wanted: Column) -> Column:
    """The places of all wanted terms in a text."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    pieces = F.arrays_zip(F.slice(F.split(text, TERM, -1), F.lit(1), F.size(found)).alias("p"), found.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        more = F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.array_contains(wanted, F.lower(x["m"])), more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out")), step)["out"]


def find_pii(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(_id, _th, spans, terms) for every row: base spans and the spans of disclosing terms."""
    base = base_spans(df, id_col=id_col, text_col=text_col)
    entity = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["match"])))
    some = F.size("spans") > 0
    base = cut(base.select("_id", "_th", F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans"), F.when(some, F.array_distinct(entity)).alias("_entities"), F.when(some, F.col("_text")).alias("_text")))

    rows = base.count()
    told = base.filter(F.col("_entities").isNotNull())
    seen = told.select("_id", "_th", F.explode("_entities").alias("entity"))
    sums = {f"_s{k}": F.sum(F.xxhash64(F.lit(k), row_key("_id"), F.col("_th")).cast("decimal(20,0)")) for k in (1, 2)}
    entities = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"), *(s.alias(c) for c, s in sums.items()))
    classes = seen.join(entities, "entity").groupBy("_id", "_th").agg(F.collect_set(F.struct("df_e", *sums)).alias("_classes"))
    classes = cut(classes.withColumnsRenamed({"_id": "_i", "_th": "_t"}))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))

    n = F.lit(float(max(rows, 1)))

    def telling(df_te: Column, df_t: Column, df_e: Column) -> Column:
        given = (df_te + F.lit(PRIOR) * df_e / n) / (df_t + F.lit(PRIOR))
        content = -F.log(df_e / n)
        return (content > 0) & (F.log(given * n / df_e) >= F.lit(float(disclosure)) * content)

    def may_tell(df_e: Column) -> Column:
        return telling(F.least(df_e, F.col("df_t")), F.col("df_t"), df_e)

    counts = df.select(F.explode(_words(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    sizes = classes.select("_i", "_t", F.array_distinct(F.transform("_classes", lambda c: c["df_e"])).alias("_sizes"))
    near = told.select("_id", "_th", "_text").join(sizes, same).select("_id", "_th", "_sizes", F.explode(_words(F.col("_text"))).alias("term"))
    near = near.join(counts, "term").filter(F.exists("_sizes", may_tell)).drop("_sizes")
    near = near.join(classes, same).select("_id", "_th", "term", "df_t", F.explode(F.filter("_classes", lambda c: may_tell(c["df_e"]))).alias("_c"))
    near = cut(near.select("_id", "_th", "term", "df_t", "_c.*"))

    texts = [F.count_distinct("_th").alias("texts")] if support > 1 else []
    both = near.groupBy("df_e", *sums, "term", "df_t").agg(F.count(F.lit(1)).alias("df_te"), *texts)
    both = both.filter(telling(F.col("df_te"), F.col("df_t"), F.col("df_e")) & (F.col("texts") >= support if texts else F.lit(True)))
    terms = near.join(both.select("df_e", *sums, "term"), ["df_e", *sums, "term"], "left_semi").groupBy("_id", "_th").agg(F.collect_set("term").alias("_terms"))
    terms = terms.withColumnsRenamed({"_id": "_i", "_th": "_t"})

    out = told.join(terms, same, "left").withColumn("terms", F.when(F.col("_terms").isNotNull(), _places(F.col("_text"), F.col("_terms"))))
    free = F.filter("terms", lambda t: ~F.exists("spans", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    none = F.array().cast(PLACES)
    out = out.select("_id", "_th", "spans", F.coalesce(free, none).alias("terms"))
    return out.unionAll(base.filter(F.col("_entities").isNull()).select("_id", "_th", "spans", none.alias("terms")))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def pii_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row a row of ``df``: counts of the kinds, n_term, the digest of base spans, and all spans."""
    out = find_pii(df, id_col=id_col, text_col=text_col, **kw)
    every = F.concat("spans", F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))
    return out.select(
        F.col("_id").alias(id_col), *(_count(k).alias(f"n_{k}") for k in KINDS),
        F.size("terms").cast("long").alias("n_term"), F.sha2(digest(F.col("spans")), 256).alias("base_sha256"), digest(every).alias("spans"),
    )


def sanitise(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``df`` with entities generalised to [EMAIL] and the like, and disclosing terms removed."""
    found = find_pii(df, id_col=id_col, text_col=text_col, **kw).filter((F.size("spans") > 0) | (F.size("terms") > 0)).dropDuplicates(["_id", "_th"])
    cuts = F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("put"))),
    )
    found = found.select("_id", "_th", F.array_sort(cuts).alias("__cuts"))
    out = df.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_th")), "left")

    def step(acc: Column, c: Column) -> Column:
        start = F.greatest(acc["at"], c["start"])
        kept = F.substring(F.col(text_col), acc["at"] + 1, start - acc["at"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.array_append(acc["out"], F.concat(kept, F.when(c["start"] >= acc["at"], c["put"]).otherwise(""))).alias("out"))

    done = F.aggregate("__cuts", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    text = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(F.col(text_col), done["at"] + 1, F.char_length(text_col))))
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in df.columns))
