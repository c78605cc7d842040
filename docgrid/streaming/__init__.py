"""Bundles as they arrive: the file checks of new manifests, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.sources.bundles import RUN

STATUSES = ("completed", "validated", "experimental")


def arriving_manifests(spark: SparkSession, root: str, files_per_trigger: int = 10_000) -> DataFrame:
    """A stream of (doc_id, arrived, status, pages_total, error) of every run.json put under ``root``."""
    source = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "run.json").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    run = source.format("text").load(root).select(F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).alias("doc_id"), F.col("_metadata.file_modification_time").alias("arrived"), F.from_json("value", RUN).alias("r"))
    error = F.when(F.col("r.source.pages_total").isNull(), "manifest.contract").when(~F.coalesce(F.col("r.status").isin(*STATUSES), F.lit(False)), "manifest.status.finished").when(~F.col("r.run_id").eqNullSafe(F.col("doc_id")), "run_id.coherent")
    return run.select("doc_id", "arrived", "r.status", "r.source.pages_total", error.alias("error"))
