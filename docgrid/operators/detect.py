"""Processing profile of each document from a sample of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions import non_space, sampled_page

#: Fixed values of detection: pages sampled, characters of a page with usable text, share of such pages.
PAGES, CHARACTERS, COVERAGE = 7, 40, 0.75
#: Sentences that say why a profile was selected.
SELECTED = (
    "digital_outline", "Selected digital_outline because both an embedded outline and a usable text layer are available.",
    "digital_reconstructed", "Selected digital_reconstructed because usable text is available but the embedded outline is absent.",
)
CLAUSE = " An embedded outline does not make the remaining pages safe for a no-OCR digital parser."
OUTLINE_ALONE = "Selected scanned_ocr because the outline alone is insufficient: the sampled pages do not contain a usable text layer."
NEITHER = "Selected scanned_ocr because neither an embedded outline nor a usable text layer is available."


def rounded(value: Column, places: int = 3) -> Column:
    """The nearest decimal of the double itself, to the even one where it lies just between.

    The rounding error of the product is found by splitting the factor, so no tie is made or lost by it.
    """
    scale = float(10**places)
    high = value * 134217729.0 - (value * 134217729.0 - value)
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    low = F.floor(product).cast("double")
    past = (product - low - 0.5) + error
    return (low + F.when((past > 0) | ((past == 0) & (low % 2 != 0)), 1.0).otherwise(0.0)) / scale


def page_characters(lines: DataFrame) -> DataFrame:
    """(doc_id, page, chars) from page lines."""
    return lines.groupBy("doc_id", "page").agg(F.sum(non_space(F.col("text"))).alias("chars"))


def sampled_characters(lines: DataFrame) -> DataFrame:
    """(doc_id, page, chars, pages_total) of the sampled pages of lines that know their document's pages_total."""
    some = lines.filter(sampled_page(F.col("page"), F.col("pages_total"), PAGES))
    return some.groupBy("doc_id", "page", "pages_total").agg(F.sum(non_space(F.col("text"))).alias("chars"))


def sample(pages: DataFrame) -> DataFrame:
    """The sampled pages; the page count comes from an aggregate, not from a window over a document.

    An input that already has pages_total is only filtered.
    """
    if "pages_total" in pages.columns:
        return pages.filter(sampled_page(F.col("page"), F.col("pages_total"), PAGES))
    total = pages.groupBy("doc_id").agg(F.max("page").alias("pages_total"))
    return pages.join(total, "doc_id").filter(sampled_page(F.col("page"), F.col("pages_total"), PAGES))


def detect_profile(pages: DataFrame, outlines: DataFrame) -> DataFrame:
    """Profile and confidence from (doc_id, page, chars) and (doc_id, has_outline)."""
    seen = sample(pages).groupBy("doc_id").agg(
        F.max("pages_total").alias("pages_total"), F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("chars") >= CHARACTERS).alias("with_text"),
        F.count_if(F.col("chars") > 0).alias("nonempty"), F.median("chars").alias("median_chars"),
    )
    seen = seen.join(outlines, "doc_id")
    text = F.col("with_text") >= F.greatest(F.lit(1), F.ceil(F.col("sampled") * COVERAGE))
    share, blank = F.col("with_text") / F.col("sampled"), F.col("nonempty") / F.col("sampled")
    scanned = F.greatest(F.lit(0.5), F.lit(0.97) - F.lit(0.25) * blank - F.when(F.col("has_outline"), F.lit(0.12)).otherwise(F.lit(0.0)))
    return seen.select(
        "doc_id", "pages_total", "sampled", "with_text", "median_chars", text.alias("text_layer"),
        F.when(text & F.col("has_outline"), "digital_outline").when(text, "digital_reconstructed").otherwise("scanned_ocr").alias("profile"),
        rounded(F.when(text & F.col("has_outline"), F.least(F.lit(1.0), F.lit(0.92) + F.lit(0.08) * share)).when(text, F.least(F.lit(0.98), F.lit(0.78) + F.lit(0.20) * share)).otherwise(scanned)).alias("confidence"),
    )


def reasons(profiles: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc_id, reasons): why each document of ``detect_profile`` has its profile, four sentences in order.

    ``outlines`` is (doc_id, entries).
    """
    p = profiles.join(outlines, "doc_id")
    sampled, required = F.col("sampled").cast("string"), F.greatest(F.lit(1), F.ceil(F.col("sampled") * COVERAGE)).cast("string")
    policy = F.concat(
        F.col("with_text").cast("string"), F.lit("/"), sampled, F.lit(" sampled pages ("), F.format_string("%.1f", F.col("with_text") / F.col("sampled") * 100), F.lit(f"%) contain at least {CHARACTERS} non-whitespace characters (minimum required: "),
        required, F.lit("/"), sampled, F.lit(f" under the {COVERAGE:.0%} digital-coverage policy)."),
    )
    outline = F.when(F.col("entries") > 0, F.concat(F.lit("Embedded PDF outline detected ("), F.col("entries").cast("string"), F.lit(" entries)."))).otherwise("No embedded PDF outline detected.")
    text = F.concat(F.when(F.col("text_layer"), "Robust text-layer coverage detected: ").otherwise("Insufficient text-layer coverage for a digital profile: "), policy)
    median = F.concat(F.lit("Median sampled text count: "), F.format_string("%.1f", "median_chars"), F.lit(" non-whitespace characters."))
    some, has = F.col("with_text") > 0, F.col("entries") > 0
    partly = F.concat(F.lit("Selected scanned_ocr fail closed because usable text appears on only "), F.col("with_text").cast("string"), F.lit("/"), sampled, F.lit(" sampled pages, below the required "), required, F.lit("/"), sampled, F.lit(" digital coverage."), F.when(has, F.lit(CLAUSE)).otherwise(""))
    why = F.when(F.col("profile") != "scanned_ocr", F.create_map(*map(F.lit, SELECTED))[F.col("profile")]).when(some, partly).when(has, OUTLINE_ALONE).otherwise(NEITHER)
    return p.select("doc_id", F.array(outline, text, median, why).alias("reasons"))
