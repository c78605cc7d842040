"""What surrounds a run: its id, selection, warnings, failures and the state of visuals without captions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from docgrid.functions import text as T
from docgrid.operators import review

#: Characters of a failure's message, the mode of routing, defaults of a manifest's paths.
MESSAGE, ROUTING = 4000, "pdf_capability_detection_v1"
PATHS = (("manual", "manual.json"), ("toc", "toc.json"), ("validation", None), ("assets", "assets"), ("diagnostics", "diagnostics"))


def base_name(path: Column) -> Column:
    """The last component of a path; with a backslash anywhere, of a path of either slash and without its drive."""
    posix = F.regexp_extract(path, r"([^/]*)/*$", 1)
    windows = F.regexp_extract(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"([^/\\]*)[/\\]*$", 1)
    return F.when(path.contains("\\"), windows).otherwise(posix)


def run_id(source: Column, at: Column) -> Column:
    """A portable id: the source's name without its ending, folded, and the time in UTC to the second."""
    stem = F.regexp_replace(base_name(source), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(T.fold(T.squeeze_ends(stem)), rf"[^{T.WORD}]+", "-"), "^[-_]+|[-_]+$", "")
    return F.concat(F.when(safe == "", "manual").otherwise(safe), F.lit("-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def fallback_id(*candidates: Column) -> Column:
    """The first candidate that can stand as a component of a path, else unknown."""
    return F.coalesce(*(F.when(T.safe_component(c), c) for c in candidates), F.lit("unknown"))


def failure_reports(failures: DataFrame) -> DataFrame:
    """Bounded rows of (run_id, source, destination, stage, error_type, message, started_at, failed_at): the name of
    the source only, at most ``MESSAGE`` characters, and the name of the file that may hold the report but for its last part."""
    stamp = F.concat(F.date_format("failed_at", "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("Z"))
    return failures.select(
        "run_id", base_name(F.col("source")).alias("source_file"), "destination", "stage", "error_type", F.substring("message", 1, MESSAGE).alias("error_message"), "started_at", "failed_at",
        F.concat(base_name(F.col("destination")), F.lit(".failure-"), stamp).alias("report_name"), (F.col("failed_at") >= F.col("started_at")).alias("coherent"),
    )


def write_failures(failures: DataFrame, path: str) -> None:
    """Add the reports to the quarantine table at ``path``; what stands there is never replaced."""
    failure_reports(failures).write.mode("append").parquet(path)


def without_captions(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and enrichment items of a run without a provider.

    Images without a caption leave retrieval; tables, captions that are there and what was out
    before are skipped with their own reason.
    """
    visual, rag = F.col("type").isin("image", "table"), F.col("include_in_rag")
    reason = F.when(~rag, F.coalesce("exclusion_reason", F.lit("excluded from retrieval"))).when(F.col("type") == "table", review.STRUCTURED).when(F.coalesce(F.col("caption") != "", F.lit(False)), review.PRESENT).otherwise(review.NO_PROVIDER)
    gone = visual & rag & (reason == review.NO_PROVIDER)
    items = elements.filter(visual).select("doc_id", "element_id", F.lit("skipped").alias("status"), reason.alias("reason"))
    out = elements.withColumns({"include_in_rag": rag & ~gone, "exclusion_reason": F.when(gone, review.NO_PROVIDER).otherwise(F.col("exclusion_reason"))})
    return out, items


def table_warnings(elements: DataFrame) -> DataFrame:
    """(doc_id, fallback, unavailable): ids, in order, of retrievable tables (doc_id, ord, element_id, type, include_in_rag, table_status) that are not structured."""
    t = elements.filter((F.col("type") == "table") & F.col("include_in_rag"))
    status = F.coalesce("table_status", F.lit("unavailable"))
    ids = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(status == s, F.struct("ord", "element_id")))), lambda x: x["element_id"].cast("string")), ", ")
    return t.groupBy("doc_id").agg(ids("fallback").alias("fallback"), ids("unavailable").alias("unavailable")).filter("fallback <> '' or unavailable <> ''")


def pipeline_selection(runs: DataFrame) -> DataFrame:
    """(doc_id, profile, parser, strategy, provider, model, config as JSON) of one row a run.

    ``runs`` has pages_total, pages_processed, confidence, threshold, crop_strategy, enabled,
    prompt_version, max_characters beside the columns that are passed on.
    """
    whole = F.col("pages_processed") == F.sequence(F.lit(1), F.col("pages_total"))
    config = F.struct(
        F.struct(F.lit("automatic").alias("mode"), F.lit(ROUTING).alias("strategy"), F.col("profile").alias("detected_profile"), F.col("confidence").alias("profile_confidence")).alias("routing"),
        F.struct(F.when(whole, "full_document").otherwise("explicit_partial").alias("selection"), F.col("pages_processed").alias("processed")).alias("pages"),
        F.struct(F.col("parser").alias("name")).alias("parser"), F.struct(F.col("strategy").alias("strategy")).alias("structure"),
        F.struct(F.struct(F.col("crop_strategy").alias("strategy"), "threshold").alias("visual_crop_filter")).alias("postprocess"),
        F.struct("enabled", "prompt_version", F.col("max_characters").alias("max_caption_characters")).alias("enrichment"), F.struct(F.lit(review.SERIALIZATION).alias("strategy")).alias("table_serialization"),
    )
    return runs.select("doc_id", "profile", "parser", "strategy", "provider", "model", F.to_json(config).alias("config"))


def artifact_paths(manifest: Column) -> Column:
    """The paths of a manifest as JSON text, by name: a key that is absent has its default, one that is null has none."""
    doc = F.try_parse_json(manifest)
    there = F.try_variant_get(doc, "$.artifacts", "map<string,variant>")
    value = lambda name, default: F.when(there.isNotNull() & F.map_contains_key(there, F.lit(name)), F.try_variant_get(F.try_element_at(there, F.lit(name)), "$", "string")).otherwise(F.lit(default))
    return F.struct(*(value(name, default).alias(name) for name, default in PATHS))


def _relative(value, root: str):
    if isinstance(value, dict):
        return {k: _relative(v, root) for k, v in value.items()}
    if isinstance(value, list):
        return [_relative(v, root) for v in value]
    if isinstance(value, str) and (value == root or value.startswith(root + "/")):
        return value[len(root) + 1 :] or "."
    return value


@F.pandas_udf(StringType())
def relative_paths(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """JSON text whose strings below a root folder are made relative to it; null for what is no JSON."""
    for documents, roots in batches:
        out = []
        for document, root in zip(documents, roots, strict=True):
            try:
                out.append(json.dumps(_relative(json.loads(document), root.rstrip("/")), ensure_ascii=False))
            except (TypeError, ValueError, AttributeError):
                out.append(None)
        yield pd.Series(out)


def last_object(output: Column) -> Column:
    """The last line of a worker's output that is a JSON object, or null."""
    lines = F.filter(F.split(output, r"\r\n|[\n\r]"), lambda line: F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False)))
    return F.try_element_at(lines, F.lit(-1))


def contract(schema: StructType) -> str:
    """A relation's schema as JSON text."""
    return schema.json()
