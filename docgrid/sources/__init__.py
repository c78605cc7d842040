"""Readers of the driver tables and the relations derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_lines(documents: DataFrame, per_page: int = 12, with_total: bool = False) -> DataFrame:
    """(doc_id, page, line_no, text): a document's lines, folded into pages of ``per_page`` lines; with its pages_total."""
    total = [(F.expr(f"(size(split(text, '\n', -1)) - 1) div {per_page}") + 1).cast("int").alias("pages_total")] if with_total else []
    lines = documents.select("doc_id", *total, F.posexplode(F.split("text", "\n", -1)).alias("_i", "text"))
    return lines.select("doc_id", (F.expr(f"_i div {per_page}") + 1).cast("int").alias("page"), F.col("_i").alias("line_no"), "text", *(["pages_total"] if with_total else []))
