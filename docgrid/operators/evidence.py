"""Votes and repetitions over pages: page-number namespaces, furniture, ranges, contexts, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Observations a namespace needs, share of pages that makes a line furniture, least crop area.
EVIDENCE, FURNITURE, CROP = 3, 0.30, 0.02


def namespaces(observations: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """The best offset of each prefix in (doc_id, prefix, pdf_page, printed_page, confidence); weights in hundredths."""
    o = observations.withColumn("page_offset", F.col("pdf_page") - F.col("printed_page"))
    o = o.groupBy("doc_id", "prefix", "page_offset").agg(F.count(F.lit(1)).alias("support"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("weight"), F.min("pdf_page").alias("pdf_start"))
    w = W.partitionBy("doc_id", "prefix").orderBy(F.col("support").desc(), F.col("weight").desc(), F.abs("page_offset"), "page_offset")
    return o.withColumn("_r", F.row_number().over(w)).filter(f"_r = 1 and support >= {evidence}").drop("_r", "weight")


def repeated_furniture(lines: DataFrame) -> DataFrame:
    """Lines of (doc_id, page, norm) that stand on at least two and three tenths of a document's pages."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    seen = lines.filter("norm <> ''").groupBy("doc_id", "norm").agg(F.count_distinct("page").alias("pages"))
    return seen.join(pages, "doc_id").filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * FURNITURE))).drop("n")


def page_ranges(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages of each document as "1-3,5"."""
    p = pages.select("doc_id", "page").distinct()
    p = p.withColumn("_g", F.col("page") - F.row_number().over(W.partitionBy("doc_id").orderBy("page")))
    p = p.groupBy("doc_id", "_g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    one = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", one.alias("t")))), lambda s: s["t"]), ",").alias("ranges"))


def local_context(rows: DataFrame, most: int = 6) -> DataFrame:
    """For each target of (doc_id, idx, is_target), its ``most`` nearest rows, as "3,4,6"; idx may have gaps."""
    order = W.partitionBy("doc_id").orderBy("idx")
    placed = rows.withColumn("_n", F.row_number().over(order))
    near = F.explode(F.filter(F.sequence(F.lit(-most), F.lit(most)), lambda k: k != 0))
    targets = placed.filter("is_target").select("doc_id", F.col("idx").alias("target"), F.col("_n").alias("_t"), near.alias("_k")).select("doc_id", "target", (F.col("_t") + F.col("_k")).alias("_n"))
    found = targets.join(placed.select("doc_id", "idx", "_n"), ["doc_id", "_n"])
    r = F.row_number().over(W.partitionBy("doc_id", "target").orderBy(F.abs(F.col("idx") - F.col("target")), "idx"))
    found = found.withColumn("_r", r).filter(F.col("_r") <= most)
    return found.groupBy("doc_id", "target").agg(F.array_join(F.sort_array(F.collect_list("idx")), ",").alias("context"))


def crop_decisions(visuals: DataFrame, threshold: float = CROP) -> DataFrame:
    """Status of each visual of (element_id, area_fraction, included); smaller than the threshold goes."""
    status: Column = (
        F.when(~F.col("included"), "preserved").when(F.col("area_fraction").isNull(), "unassessed").when(F.col("area_fraction") < threshold, "excluded").otherwise("kept")
    )
    return visuals.withColumn("status", status)


def duplicate_ids(*ids: DataFrame) -> DataFrame:
    """Ids that occur more than once over all of ``ids``."""
    every = ids[0]
    for more in ids[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def report_status(checks: DataFrame) -> DataFrame:
    """Whether all checks of a document passed, and how many did not."""
    return checks.groupBy("doc_id").agg(F.bool_and("passed").alias("valid"), F.count_if(~F.col("passed")).alias("failed"))
