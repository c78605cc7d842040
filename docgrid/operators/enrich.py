"""Captions for visual elements from a provider that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators import captions

#: The reasons that are written with an item's state.
EXCLUDED, TABLE, PRESENT = "excluded from retrieval", "table uses structured serialization", "caption already present"
VALIDATED, UNAVAILABLE = "caption validated", "caption unavailable after enrichment failure"

Provider = Callable[[str, str, str, bytes | None], str]


def enrich(elements: DataFrame, provider: Callable[[], Provider], *, prompt_version: str = captions.CURRENT, overwrite: bool = False) -> DataFrame:
    """Every image and table of (doc_id, element_id, type, include, exclusion_reason, caption, prompt, asset) with its state.

    Adds status (skipped, enriched, review_required or failed), reason, new_caption, input_sha256
    and retrievable. ``provider`` makes the function that captions one element; it is called once
    a task, and a call that raises fails its element, not the job. Calls are made again if the
    result is computed again, so write it before use. An asset of null is left out of the digest.
    """
    visual = elements.filter("type in ('image', 'table')")
    skip = F.when(~F.col("include"), F.coalesce("exclusion_reason", F.lit(EXCLUDED))).when(F.col("type") == "table", TABLE)
    if not overwrite:
        skip = skip.when(F.coalesce(F.col("caption") != "", F.lit(False)), PRESENT)
    state = visual.withColumn("_skip", skip)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()
        for frame in frames:
            said, errors = [], []
            for row in frame.itertuples():
                try:
                    said.append(ask(row.element_id, row.type, row.prompt, row.asset))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  any failure of a provider is a value here
                    said.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "element_id": frame["element_id"], "_said": said, "_error": errors})

    kind = {c: elements.schema[c].dataType.simpleString() for c in ("doc_id", "element_id")}
    jobs = state.filter("_skip is null").select("doc_id", "element_id", "type", "prompt", "asset")
    answers = jobs.mapInPandas(call, f"doc_id {kind['doc_id']}, element_id {kind['element_id']}, _said string, _error string")
    version = F.lit(prompt_version)
    out = state.join(answers, ["doc_id", "element_id"], "left").withColumn("new_caption", captions.canonical_caption(F.col("_said"), version))
    out = out.withColumn("_review", captions.review_reason(F.col("new_caption"), version))
    done = F.col("new_caption").isNotNull()
    digest = F.sha2(F.concat(F.encode(F.concat(F.col("element_id").cast("string"), "type", "prompt"), "UTF-8"), F.coalesce("asset", F.lit(b""))), 256)
    status = F.when(F.col("_skip").isNotNull(), "skipped").when(~done, "failed").when(F.col("_review").isNotNull(), "review_required").otherwise("enriched")
    reason = F.coalesce("_skip", F.when(done, F.coalesce("_review", F.lit(VALIDATED))), "_error", F.lit("caption breaks its contract"))
    out = out.withColumns({"status": status, "reason": reason, "input_sha256": F.when(done, digest)})
    return out.withColumn("retrievable", F.col("include") & F.col("status").isin("skipped", "enriched")).drop("_skip", "_said", "_error", "_review")
