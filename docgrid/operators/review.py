"""Agreement of a finished run with its own diagnostics, and the reports that say so.

``elements`` here are (doc_id, element_id, type, page, include_in_rag, exclusion_reason, caption,
provider, model, prompt_version, runtime_version, params map, input_sha256); a caption without
provider has no provenance. ``items`` are (doc_id, element_id, status, reason) of enrichment, ``crops``
(doc_id, element_id, status, reason), ``runs`` one row a document. An error is a row of (doc_id, id, error).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.operators import captions
from docgrid.operators.assembly import INDEX_PAGE

#: The reasons that diagnostics give.
PRESENT, VALIDATED, STRUCTURED = "caption already present", "caption validated", "table uses structured serialization"
UNAVAILABLE, NO_PROVIDER, SMALL = "caption unavailable after enrichment failure", "caption provider unavailable in diagnostic run", "visual crop below page-area threshold"
SERIALIZATION = "header_value_rows_v1"
#: The accepted set-up of captions.
PROVIDER, MODEL = "ollama", "qwen3.5:4b"
PARAMETERS = ("temperature", "num_predict", "repeat_penalty", "num_ctx")


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def has_provenance() -> Column:
    return F.col("provider").isNotNull()


def reviewed(use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of an element's canonical caption and of why it needs a review, null for an invalid one; each is computed once."""
    prompt = F.coalesce("prompt_version", F.lit(captions.CURRENT))
    return T.let(captions.canonical_caption(F.col("caption"), prompt), lambda c: T.let(captions.review_reason(c, prompt), lambda due: use(c, due)))


def id_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, id, side) of ids that stand on one side only."""
    a, b = (d.select("doc_id", "id").distinct().withColumn(n, F.lit(True)) for d, n in ((left, "_a"), (right, "_b")))
    both = a.join(b, ["doc_id", "id"], "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select("doc_id", "id", F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def _joined(elements: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    i = items.select("doc_id", "element_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    return i.join(elements, ["doc_id", "element_id"]).join(runs.select("doc_id", "provider_configured"), "doc_id")


def item_errors(elements: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items of enrichment whose status is not that of the element as it stands."""
    e = _joined(elements, items, runs)
    status, reason, has = F.col("_status"), F.col("_reason"), F.coalesce(F.col("caption") != "", F.lit(False))
    rag, why = F.col("include_in_rag"), F.col("exclusion_reason")
    table = (F.col("type") == "table") & rag & ~has & ~has_provenance() & (reason == STRUCTURED)
    failed = F.col("provider_configured") & (F.col("type") == "image") & ~has & ~has_provenance() & ~rag & (why == UNAVAILABLE) & (T.squeeze(reason) != "")

    def error(canonical: Column, due: Column) -> Column:
        enriched = F.col("provider_configured") & has & has_provenance() & due.isNull() & rag & (reason == VALIDATED)
        waiting = F.col("provider_configured") & has & has_provenance() & due.isNotNull() & ~rag & (why == due) & (reason == due)
        excluded = ~rag & (why != "") & (reason == why) & due.isNull()
        there = has & has_provenance() & rag & due.isNull() & (reason == PRESENT)
        good = F.when(status == "enriched", _is(enriched)).when(status == "review_required", _is(waiting)).when(status == "skipped", _is(excluded) | _is(there) | _is(table)).otherwise(_is(failed))
        return F.when(F.col("caption").isNotNull() & canonical.isNull(), "invalid_caption").when(~good, "status")

    # exploded, as a filter on the error would compute it once more
    return e.select("doc_id", F.col("element_id").alias("id"), F.explode(F.array_compact(F.array(reviewed(error)))).alias("error"))


def transition_errors(elements: DataFrame, items: DataFrame, crops: DataFrame, runs: DataFrame) -> DataFrame:
    """Visuals whose way from crop to enrichment to the document cannot be."""
    c = crops.select("doc_id", "element_id", F.col("status").alias("_crop"), F.col("reason").alias("_why"))
    e = _joined(elements, items, runs).join(c, ["doc_id", "element_id"])
    status, reason, rag, why = F.col("_status"), F.col("_reason"), F.col("include_in_rag"), F.col("exclusion_reason")
    skipped = status == "skipped"
    good = (
        F.when(F.col("_crop").isin("excluded", "preserved"), skipped & ~rag & (reason == F.col("_why")) & (reason == why))
        .when(status == "enriched", rag).when(status == "review_required", ~rag)
        .when(status == "failed", (F.col("type") == "image") & ~rag & (why == UNAVAILABLE))
        .when((F.col("type") == "table") & skipped & (reason == STRUCTURED) & rag, True)
        .when(skipped & (reason == PRESENT) & rag, True)
        .when(F.col("provider_configured"), False)
        .otherwise(skipped & (reason == NO_PROVIDER) & ~rag & (why == NO_PROVIDER))
    )
    return e.filter(~_is(good)).select("doc_id", F.col("element_id").alias("id"), F.lit("transition").alias("error"))


def exclusion_errors(elements: DataFrame, items: DataFrame, crops: DataFrame, runs: DataFrame) -> DataFrame:
    """Elements out of retrieval for none of the five causes; ``runs`` adds profile and index_pages array."""
    i = items.select("doc_id", "element_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    c = crops.select("doc_id", "element_id", F.col("status").alias("_crop"))
    e = elements.filter(~F.col("include_in_rag")).join(i, ["doc_id", "element_id"], "left").join(c, ["doc_id", "element_id"], "left").join(runs.select("doc_id", "provider_configured", "profile", "index_pages"), "doc_id")
    why, kind = F.col("exclusion_reason"), F.col("type")
    causes = (
        (why == SMALL) & kind.isin("image", "table") & (F.col("_crop") == "excluded"),
        (why == NO_PROVIDER) & (kind == "image") & ~F.col("provider_configured") & (F.col("_status") == "skipped") & (F.col("_reason") == why),
        (F.col("_status") == "review_required") & (reviewed(lambda _, due: due) == why),
        (why == UNAVAILABLE) & (kind == "image") & F.col("provider_configured") & (F.col("_status") == "failed"),
        (why == INDEX_PAGE) & (F.col("profile") == "scanned_ocr") & F.array_contains("index_pages", F.col("page")),
    )
    any_ = F.lit(False)
    for cause in causes:
        any_ = any_ | _is(cause)
    return e.filter(~any_).select("doc_id", F.col("element_id").alias("id"), F.lit("exclusion").alias("error"))


def caption_errors(elements: DataFrame) -> DataFrame:
    """Captions without provenance and the reverse, on other elements than images and tables, invalid, not canonical, or in retrieval though a review is due."""
    has, blank = F.coalesce(F.col("caption") != "", F.lit(False)), F.coalesce(T.squeeze(F.col("caption")) == "", F.lit(True))
    visual, rag = F.col("type").isin("image", "table"), F.col("include_in_rag")

    def found(canonical: Column, due: Column) -> Column:
        rules = {
            "empty": F.col("caption").isNotNull() & blank, "not_visual": has & ~visual, "no_provenance": ~blank & ~has_provenance(), "no_caption": has_provenance() & blank, "image_without": (F.col("type") == "image") & rag & ~has,
            "invalid": has & canonical.isNull(), "not_canonical": canonical.isNotNull() & (T.squeeze_ends(F.col("caption")) != canonical), "review": due.isNotNull() & (rag | ~F.col("exclusion_reason").eqNullSafe(due)),
        }
        return F.array_compact(F.array(*(F.when(_is(rule), F.lit(name)) for name, rule in rules.items())))

    return elements.select("doc_id", F.col("element_id").alias("id"), F.explode(reviewed(found)).alias("error"))


def release_version(version: Column) -> Column:
    """Whether a runtime's version is that of a release: two or more numbers between dots."""
    return F.coalesce(version.rlike(r"^\d+(\.\d+)+$"), F.lit(False))


def identity_errors(runs: DataFrame, elements: DataFrame, most: int = captions.MOST) -> DataFrame:
    """(doc_id, error) where captions disagree with each other or with the run's set-up.

    ``runs`` is (doc_id, provider, model, enabled, prompt_version, max_characters, preflight_model,
    preflight_version, preflight_digest, accepted_digest).
    """
    seen = elements.filter(has_provenance()).groupBy("doc_id").agg(
        F.collect_set(F.struct("provider", "model")).alias("_ids"), F.collect_set("prompt_version").alias("_prompts"), F.collect_set("runtime_version").alias("_versions"), F.count_if(F.col("runtime_version").isNull()).alias("_bare"),
    )
    r = runs.join(seen, "doc_id", "left")
    ids, some = F.coalesce(F.size("_ids"), F.lit(0)), F.coalesce(F.size("_prompts"), F.lit(0)) > 0
    used, needed = F.col("enabled") | some, F.col("enabled") | (ids > 0)
    one, own = F.get("_ids", F.lit(0)), (F.col("provider") == PROVIDER)
    version = F.col("preflight_version")
    clean = _is((version != "") & (T.squeeze_ends(version) == version))
    rules = {
        "identities": ids > 1, "identity": (ids == 1) & ~(one["provider"].eqNullSafe(F.col("provider")) & one["model"].eqNullSafe(F.col("model"))),
        "prompt": used & ~_is(F.col("prompt_version").isin(*captions.PROMPTS)), "prompts": _is(F.exists("_prompts", lambda p: ~p.eqNullSafe(F.col("prompt_version")))),
        "length": used & ~F.col("max_characters").eqNullSafe(F.lit(most)), "preflight_model": needed & ~F.col("preflight_model").eqNullSafe(F.col("model")), "preflight_version": needed & ~clean,
        "digest": needed & own & ~_is(F.col("preflight_digest").rlike("^[0-9a-f]{64}$")), "accepted_model": needed & own & ~F.col("preflight_model").eqNullSafe(F.lit(MODEL)), "release": needed & own & _is(F.col("prompt_version").isin(*captions.PROMPTS)) & ~release_version(version),
        "accepted_digest": needed & own & ~F.col("preflight_digest").eqNullSafe(F.col("accepted_digest")), "runtime": _is(version != "") & ((F.coalesce("_bare", F.lit(0)) > 0) | _is(F.exists("_versions", lambda v: v != version))),
    }
    found = F.filter(F.array(*(F.when(_is(rule), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return r.select("doc_id", F.explode(found).alias("error"))


def enrichment_evidence(runs: DataFrame, elements: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, passed, reason): whether captions were made with the accepted set-up, none failed and none is left out for want of a provider.

    ``runs`` is that of ``identity_errors`` with provider_configured and provider_config map.
    """
    failed = items.groupBy("doc_id").agg(F.count_if(F.col("status") == "failed").alias("_failed"))
    left = elements.groupBy("doc_id").agg(F.count_if((F.col("type") == "image") & (F.col("exclusion_reason") == NO_PROVIDER)).alias("_left"))
    r = runs.join(failed, "doc_id", "left").join(left, "doc_id", "left")
    there = _is(F.col("enabled") & F.col("provider").isNotNull() & F.col("model").isNotNull() & F.col("provider_configured"))
    set_up = (F.col("provider") == PROVIDER) & (F.col("model") == MODEL) & (F.try_element_at("provider_config", F.lit("model")) == MODEL) & F.col("prompt_version").isin(*captions.PROMPTS)
    pinned = release_version(F.col("preflight_version")) & (F.col("preflight_model") == MODEL) & (F.col("preflight_digest") == F.col("accepted_digest"))
    reason = F.when(~there, "not_configured").when(~_is(set_up & pinned), "set_up").when(F.coalesce("_failed", F.lit(0)) > 0, "failed").when(F.coalesce("_left", F.lit(0)) > 0, "left_out")
    return r.select("doc_id", reason.isNull().alias("passed"), reason.alias("reason"))


def report_checks(runs: DataFrame, errors: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, check_id, passed, errors) of every check for every run, from the error rows (doc_id, ...) of each.

    The rows are counted by document before they meet, so a report costs one aggregate over all errors.
    """
    every = None
    for check_id, rows in errors.items():
        part = rows.select("doc_id", F.lit(check_id).alias("check_id"))
        every = part if every is None else every.unionByName(part)
    found = every.groupBy("doc_id", "check_id").agg(F.count(F.lit(1)).alias("errors"))
    wanted = runs.select("doc_id", F.explode(F.array(*map(F.lit, errors))).alias("check_id"))
    out = wanted.join(found, ["doc_id", "check_id"], "left")
    return out.select("doc_id", "check_id", F.col("errors").isNull().alias("passed"), F.coalesce("errors", F.lit(0).cast("long")).alias("errors"))


def parameter_errors(elements: DataFrame, runs: DataFrame) -> DataFrame:
    """Captions made with other output parameters than the run's ``provider_config`` map names."""
    e = elements.filter(has_provenance()).join(runs.select("doc_id", "provider_config"), "doc_id")
    key = F.explode(F.array(*map(F.lit, PARAMETERS))).alias("key")
    e = e.select("doc_id", "element_id", "params", "provider_config", key).filter(F.map_contains_key("provider_config", F.col("key")))
    return e.filter(~F.try_element_at("params", F.col("key")).eqNullSafe(F.try_element_at("provider_config", F.col("key")))).select("doc_id", F.col("element_id").alias("id"), F.col("key").alias("error"))


def replayed_outline(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, ord, level, title, page): the entries that printed rows and their matches give, first ones of equals.

    ``rows`` is (doc_id, row_index, level, title), ``matches`` (doc_id, ord, row_index, page); a null page is unresolved.
    """
    m = matches.filter("page is not null").join(rows, ["doc_id", "row_index"])
    first = W.partitionBy("doc_id", "level", T.fold_title(F.col("title")), "page").orderBy("ord")
    m = m.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return m.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1).alias("ord"), "level", "title", "page")


def replay_errors(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, row_index, error): rows without a match, matches without a row, and rows matched twice."""
    r = rows.select("doc_id", "row_index").distinct().withColumn("_r", F.lit(True))
    m = matches.groupBy("doc_id", "row_index").agg(F.count(F.lit(1)).alias("_n"))
    error = F.when(F.col("_r").isNull(), "no_row").when(F.col("_n").isNull(), "no_match").when(F.col("_n") > 1, "repeated")
    return r.join(m, ["doc_id", "row_index"], "full_outer").select("doc_id", "row_index", error.alias("error")).filter("error is not null")


def serialization_errors(persisted: DataFrame, computed: DataFrame) -> DataFrame:
    """(doc_id, element_id, error): tables whose rows (doc_id, element_id, row_id, serialized_text) are missing or not those computed anew."""
    p, c = (d.select("doc_id", "element_id", "row_id", F.col("serialized_text").alias(n)) for d, n in ((persisted, "_p"), (computed, "_c")))
    both = p.join(c, ["doc_id", "element_id", "row_id"], "full_outer")
    lacking = persisted.select("doc_id", "element_id").distinct().withColumn("_there", F.lit(True))
    bad = both.filter(~F.col("_p").eqNullSafe(F.col("_c"))).select("doc_id", "element_id").distinct().join(lacking, ["doc_id", "element_id"], "left")
    return bad.select("doc_id", "element_id", F.when(F.col("_there").isNull(), "missing").otherwise("differs").alias("error"))


#: Columns in which a manual and its manifest must agree: error, of the manual, of the manifest.
SOURCE = (("pages_total", "manual_pages", "source_pages"), ("source_file", "manual_file", "source_file"), ("profile", "manual_profile", "profile"), ("parser", "manual_parser", "parser"), ("strategy", "manual_strategy", "strategy"))


def source_errors(runs: DataFrame) -> DataFrame:
    """(doc_id, error): where manual and manifest disagree, and contents that are there against what is said."""
    rules = [(name, F.col(a).eqNullSafe(F.col(b))) for name, a, b in SOURCE] + [("toc", F.col("toc_available").eqNullSafe(F.col("toc_entries") > 0)), ("run_id", F.col("run_id").eqNullSafe(F.col("manual_id")))]
    found = F.filter(F.array(*(F.when(~_is(ok), F.lit(name)) for name, ok in rules)), lambda x: x.isNotNull())
    return runs.select("doc_id", F.explode(found).alias("error"))


def unsupported_status(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """(doc_id, failed): runs that say they are validated without evidence, or against the gates named, in order."""
    failed = gates.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("gate_no", "gate_id")))), lambda g: g["gate_id"]), ",").alias("failed"))
    return runs.filter("status = 'validated'").select("doc_id").join(failed, "doc_id", "left").filter("failed is null or failed <> ''")


def report_differences(declared: DataFrame, computed: DataFrame) -> DataFrame:
    """(doc_id, check_id, error): checks of (doc_id, check_id, passed) that one report lacks, repeats or decides otherwise."""
    d = declared.groupBy("doc_id", "check_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("passed").alias("_p"))
    c = computed.groupBy("doc_id", "check_id").agg(F.bool_and("passed").alias("_q"))
    error = F.when(F.col("_n") > 1, "repeated").when(F.col("_p").isNull(), "undeclared").when(F.col("_q").isNull(), "unknown").when(F.col("_p") != F.col("_q"), "differs")
    return d.join(c, ["doc_id", "check_id"], "full_outer").select("doc_id", "check_id", error.alias("error")).filter("error is not null")


def replaced_check(checks: DataFrame, documents: DataFrame, check_id: str = "validation.artifact") -> DataFrame:
    """``checks`` with one of them failed for the given documents."""
    stale = documents.select("doc_id").distinct().withColumn("_stale", F.lit(True))
    out = checks.join(stale, "doc_id", "left")
    return out.withColumn("passed", F.when(F.col("_stale").isNotNull() & (F.col("check_id") == check_id), F.lit(False)).otherwise(F.col("passed"))).drop("_stale")


def run_metrics(runs: DataFrame, chapters: DataFrame, elements: DataFrame, toc: DataFrame, table_rows: DataFrame, checks: DataFrame) -> DataFrame:
    """One row a run: counts of chapters, elements, pages, captions, tables by status, rows, contents and failed checks.

    ``elements`` has type, page, caption and table_status; one aggregate a relation, then joins on doc_id.
    """
    n = lambda c: F.count_if(_is(c)).alias
    e = elements.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("element_count"), F.count_distinct("page").alias("element_page_count"), n(T.squeeze(F.col("caption")) != "")("caption_count"), n(F.col("type") == "table")("table_count"),
        *(n((F.col("type") == "table") & (F.col("table_status") == s))(f"table_{s}_count") for s in ("structured", "fallback", "unavailable")),
    )
    out = runs.select("doc_id", F.col("pages_total").alias("source_pages_total"))
    count = lambda d, name: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    parts = (count(chapters, "chapter_count"), e, count(toc, "toc_entry_count"), count(table_rows, "table_row_count"), checks.groupBy("doc_id").agg(F.count_if(~F.col("passed")).alias("failed_check_count")))
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out.na.fill(0)


def status_counts(items: DataFrame, *states: str) -> DataFrame:
    """One row a document: how many of (doc_id, status) have each of the states."""
    return items.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in states))


def bundle_errors(runs: DataFrame) -> DataFrame:
    """(doc_id, error) before a bundle is written: ids that differ, a finished state without a passed report."""
    finished = F.col("status").isin("validated", "experimental")
    rules = {"manual_id": ~F.col("run_id").eqNullSafe(F.col("manual_id")), "report_id": ~F.col("run_id").eqNullSafe(F.col("report_id")), "status": finished & ~F.col("report_status").eqNullSafe(F.lit("passed")), "unsafe_id": ~T.safe_component(F.col("run_id"))}
    found = F.filter(F.array(*(F.when(_is(rule), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return runs.select("doc_id", F.explode(found).alias("error"))
