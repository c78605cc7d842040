"""Checks of finished documents, promotion gates and the fingerprint of a bundle.

Relations: runs (doc_id, pages_total, pages_processed array, ...), chapters (doc_id, ord,
parent_ord, level, title, page), toc (doc_id, ord, level, title, page), elements (doc_id,
element_id, chapter_ord, declared_ord, page, image_path), files (doc_id, path). A check never
throws: what cannot be evaluated has failed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions import text as T

#: Share of processed pages that need elements, markers of warnings that matter, accepted set-ups.
COVERAGE = 0.75
MARKERS = ("ambiguous", "failed", "fallback", "incomplete", "missing", "out of order", "partial", "restructure", "timed out", "unmatched", "unavailable", "unresolved")
EMBEDDED, PRINTED = "embedded_outline", "printed_toc_body_heading_fusion_v1"
SCANNED_EMBEDDED, SCANNED_PRINTED, SCANNED_TITLES = "embedded_outline_with_paddle_ocr", "ocr_printed_toc_title_fusion_v1", "ocr_structural_titles_fallback_v1"
GATES = ("document.full", "enrichment.configured", "captions.identity", "enrichment.review_free", "warnings.nonconsequential", "profile.accepted", "structure.accepted")
CHECKS = ("pages.bounds", "pages.content.coverage", "ids.unique", "trace.parents.coherent", "assets.paths.safe", "assets.exist", "toc.hierarchy.coherent", "toc.pages.bounds")


def coverage(runs: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, covered, required, missing): processed pages with elements, and those without."""
    pages = runs.select("doc_id", F.explode(F.array_distinct("pages_processed")).alias("page"))
    seen = elements.select("doc_id", "page").distinct().withColumn("_e", F.lit(True))
    per = pages.join(seen, ["doc_id", "page"], "left").groupBy("doc_id").agg(
        F.count("_e").alias("covered"), F.ceil(F.count(F.lit(1)) * COVERAGE).alias("required"), F.sort_array(F.collect_list(F.when(F.col("_e").isNull(), F.col("page")))).alias("missing")
    )
    return per.withColumn("passed", F.col("covered") >= F.col("required"))


def parent_errors(chapters: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, id) of chapters that are not deeper than their parent, and elements that declare another chapter."""
    p = chapters.select("doc_id", F.col("ord").alias("parent_ord"), F.col("level").alias("_l"))
    a = chapters.join(p, ["doc_id", "parent_ord"]).filter("level <= _l").select("doc_id", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("id"))
    return a.unionByName(elements.filter(~F.col("declared_ord").eqNullSafe(F.col("chapter_ord"))).select("doc_id", F.col("element_id").cast("string").alias("id")))


def toc_differences(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, ord) where the contents and the chapters in preorder differ or one ends."""
    t, c = (d.select("doc_id", "ord", F.struct("level", "title", "page").alias(n)) for d, n in ((toc, "t"), (chapters, "c")))
    return t.join(c, ["doc_id", "ord"], "full_outer").filter(~F.col("t").eqNullSafe(F.col("c"))).select("doc_id", "ord")


def missing_assets(elements: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, element_id, image_path) of referenced images that are not among the files."""
    refs = elements.filter("image_path is not null and image_path <> ''").select("doc_id", "element_id", "image_path")
    return refs.join(files.select("doc_id", F.col("path").alias("image_path")), ["doc_id", "image_path"], "left_anti").select("doc_id", "element_id", "image_path")


def document_checks(runs: DataFrame, toc: DataFrame, chapters: DataFrame, elements: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, check_id, passed, errors) for all of ``CHECKS`` of each run."""
    total = runs.select("doc_id", "pages_total", "pages_processed")
    beyond = lambda d: d.select("doc_id", "page").join(total, "doc_id").filter("page > pages_total")
    unread = elements.select("doc_id", "page").join(total, "doc_id").filter(~F.array_contains("pages_processed", F.col("page")))
    ids = chapters.select("doc_id", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("id")).unionByName(elements.select("doc_id", F.col("element_id").cast("string").alias("id")))
    read = F.size("pages_processed") > 0
    faults = {
        "pages.bounds": beyond(chapters).select("doc_id").unionAll(beyond(elements).select("doc_id")).unionAll(unread.select("doc_id")).unionAll(total.filter(~read | F.exists("pages_processed", lambda p: p > F.col("pages_total"))).select("doc_id")),
        "pages.content.coverage": coverage(runs, elements).filter("not passed").select("doc_id").unionAll(total.filter(~read).select("doc_id")),
        "ids.unique": ids.groupBy("doc_id", "id").count().filter("count > 1").select("doc_id"),
        "trace.parents.coherent": parent_errors(chapters, elements).select("doc_id"),
        "assets.paths.safe": elements.filter(F.col("image_path").isNotNull() & ~T.safe_path(F.col("image_path"))).select("doc_id"),
        "assets.exist": missing_assets(elements, files).select("doc_id"),
        "toc.hierarchy.coherent": toc_differences(toc, chapters).select("doc_id").unionAll(total.select("doc_id").join(toc.select("doc_id").distinct(), "doc_id", "left_anti")),
        "toc.pages.bounds": beyond(toc).select("doc_id"),
    }
    found = None
    for name in CHECKS:
        part = faults[name].withColumn("check_id", F.lit(name))
        found = part if found is None else found.unionByName(part)
    counts = found.groupBy("doc_id", "check_id").agg(F.count(F.lit(1)).alias("errors"))
    every = runs.select("doc_id", F.explode(F.array(*map(F.lit, CHECKS))).alias("check_id"))
    out = every.join(counts, ["doc_id", "check_id"], "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("long")))
    return out.select("doc_id", "check_id", (F.col("errors") == 0).alias("passed"), "errors")


def consequential(warning: Column) -> Column:
    folded, out = T.fold(warning), F.lit(False)
    for marker in MARKERS:
        out = out | folded.contains(marker)
    return out


def promotion_gates(runs: DataFrame, evidence: str | None = None) -> DataFrame:
    """(doc_id, gate_no, gate_id, passed), the gates of each run in order.

    Besides pages and profile, ``runs`` has parser, strategy, has_outline, warnings array,
    enrichment_ok, identities (number of distinct caption models), reviews and reviews_declared,
    mode and resolved_ratio. Scanned runs need an ``evidence`` id.
    """
    profile, strategy, parser = F.col("profile"), F.col("strategy"), F.col("parser")
    scanned = profile == "scanned_ocr"
    setup = (
        F.when(profile == "digital_outline", (parser == "docling") & (strategy == EMBEDDED)).when(profile == "digital_reconstructed", (parser == "docling") & (strategy == PRINTED))
        .when(scanned, (parser == "paddleocr_vl") & strategy.isin(SCANNED_EMBEDDED, SCANNED_PRINTED, SCANNED_TITLES) & (F.col("has_outline") == (strategy == SCANNED_EMBEDDED)) & F.lit(bool(evidence and evidence.strip())))
    )
    gates = (
        F.col("pages_processed") == F.sequence(F.lit(1), F.col("pages_total")), F.col("enrichment_ok"), F.col("identities") <= 1,
        (F.col("reviews") == 0) & (F.col("reviews_declared") == 0), ~F.exists("warnings", consequential), setup,
        ~scanned | (strategy == SCANNED_EMBEDDED) | ((strategy == SCANNED_PRINTED) & (F.col("mode") == "printed_index") & (F.col("resolved_ratio") == 1.0)),
    )
    rows = F.array(*(F.struct(F.lit(i + 1).alias("gate_no"), F.lit(n).alias("gate_id"), F.coalesce(g, F.lit(False)).alias("passed")) for i, (n, g) in enumerate(zip(GATES, gates, strict=True))))
    return runs.select("doc_id", F.explode(rows).alias("g")).select("doc_id", "g.*")


def crop_coherence(decisions: DataFrame, visuals: DataFrame) -> DataFrame:
    """(doc_id, element_id, error): visuals without decision, decisions without visual, and areas or states that differ.

    Both are (doc_id, element_id, area_fraction, status).
    """
    d, v = (x.select("doc_id", "element_id", F.struct("area_fraction", "status").alias(n)) for x, n in ((decisions, "d"), (visuals, "v")))
    both = d.join(v, ["doc_id", "element_id"], "full_outer")
    error = F.when(F.col("v").isNull(), "no_visual").when(F.col("d").isNull(), "no_decision").when(~F.col("d.area_fraction").eqNullSafe(F.col("v.area_fraction")), "area").when(~F.col("d.status").eqNullSafe(F.col("v.status")), "status")
    return both.select("doc_id", "element_id", error.alias("error")).filter("error is not null")


def path_collisions(paths: DataFrame) -> DataFrame:
    """(doc_id, name, other) of (doc_id, name, path) where one path is the other or a folder of it.

    Each path is joined by equality with the folders of all others, so no two paths are compared
    that do not collide.
    """
    p = paths.filter(T.safe_path(F.col("path"))).select("doc_id", "name", T.path_parts(F.col("path")).alias("parts"))
    heads = p.select("doc_id", F.col("name").alias("other"), F.size("parts").alias("_n"), F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"), "parts").withColumn("key", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"))
    whole = p.select("doc_id", "name", F.array_join("parts", "/").alias("key"))
    pairs = whole.join(heads, ["doc_id", "key"]).filter((F.col("name") < F.col("other")) | ((F.col("name") > F.col("other")) & (F.col("k") < F.col("_n"))))
    return pairs.select("doc_id", F.least("name", "other").alias("name"), F.greatest("name", "other").alias("other")).distinct()


def fingerprint(files: DataFrame, excluded: Column | None = None) -> DataFrame:
    """(doc_id, sha256) over all files (doc_id, path, content) but the ``excluded`` ones.

    In the order of paths: the path's length in eight bytes, the path, the content, a zero byte. A
    bundle's files are sorted within a task and read one after another; none but the current is held.
    """
    kept = files if excluded is None else files.filter(~excluded)
    kind = files.schema["doc_id"].dataType
    rows = kept.select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("path", "UTF-8").alias("path"), F.col("content").cast("binary").alias("content"))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "path")

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for frame in frames:
            done = []
            for doc, path, content in zip(frame["doc_id"], frame["path"], frame["content"], strict=True):
                if digest is None or doc != at:
                    done += [(at, digest.hexdigest())] if digest else []
                    at, digest = doc, hashlib.sha256()
                digest.update(len(path).to_bytes(8, "big") + bytes(path))
                digest.update(content or b"")
                digest.update(b"\0")
            yield pd.DataFrame(done, columns=["doc_id", "sha256"])
        if digest:
            yield pd.DataFrame([(at, digest.hexdigest())], columns=["doc_id", "sha256"])

    return rows.mapInPandas(digests, "doc_id string, sha256 string").select(F.col("doc_id").cast(kind).alias("doc_id"), "sha256")
