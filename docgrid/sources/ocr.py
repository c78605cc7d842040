"""Recognition of pages and captions behind injected callables, one batch a task.

A recogniser is made once a Python worker by ``make() -> recognise(pages: list[dict]) -> list[dict]``,
with one answer a page: page, blocks (dicts), angle. What it raises becomes an error row of its batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators.blocks import batches

Recognise = Callable[[list[dict]], list[dict]]
RAW = "doc_id string, page int, batch int, response string, seconds double, error string"
#: Keys by which a block's text, box and order may be named, the first that is there counts.
TEXT, BOX, ORDER, LABEL = ("block_content", "text", "content", "markdown", "html"), ("block_bbox", "bbox", "coordinate"), ("block_order", "order"), ("block_label", "label")
#: Keys of a recogniser's settings that are passed on.
SETTINGS = ("device", "engine", "language", "pipeline_version", "use_chart_recognition", "use_doc_orientation_classify", "use_doc_unwarping", "use_layout_detection")


def known_settings(given: dict) -> dict:
    """The settings that are known and not null."""
    return {k: given[k] for k in SETTINGS if given.get(k) is not None}


def request_error(pages: list[int]) -> str | None:
    """What is wrong with the pages of a request: they must be there, positive whole numbers, and different."""
    if not pages:
        return "no pages"
    if any(isinstance(p, bool) or not isinstance(p, int) or p < 1 for p in pages):
        return "pages must be positive whole numbers"
    return "pages repeat" if len(set(pages)) < len(pages) else None


def recognise(pages: DataFrame, make: Callable[[], Recognise], size: int = 6) -> DataFrame:
    """(doc_id, page, batch, response as JSON, seconds, error) of ``pages`` (doc_id, page, asset).

    Batches of ``size`` pages of a document are dealt out as wholes; the model is made once a worker.
    """
    dealt = batches(pages, size).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "batch", F.col("asset").cast("string").alias("asset"))
    dealt = dealt.repartition("doc_id", "batch").sortWithinPartitions("doc_id", "batch", "page")

    def one(model: Recognise, doc: str, batch: int, rows: list[dict]) -> list[tuple]:
        began, numbers = time.monotonic(), [r["page"] for r in rows]
        try:
            if wrong := request_error(numbers):
                raise ValueError(wrong)
            answers = {a["page"]: a for a in model(rows)}
            if sorted(answers) != sorted(numbers):
                raise ValueError(f"asked for pages {numbers}, got {sorted(answers)}")
            out = [(doc, p, batch, json.dumps(answers[p], ensure_ascii=False), None) for p in numbers]
        except Exception as error:  # noqa: BLE001 a batch that fails is rows
            out = [(doc, p, batch, None, f"{type(error).__name__}: {error}"[:4000]) for p in numbers]
        took = (time.monotonic() - began) / len(rows)
        return [(*row[:4], took, row[4]) for row in out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held, key = None, [], None
        for frame in frames:
            for row in frame.to_dict("records"):
                if held and key != (row["doc_id"], row["batch"]):
                    model = model or make()
                    yield pd.DataFrame(one(model, *key, held), columns=["doc_id", "page", "batch", "response", "seconds", "error"])
                    held = []
                key = row["doc_id"], row["batch"]
                held.append({"page": int(row["page"]), "asset": row["asset"]})
        if held:
            model = model or make()
            yield pd.DataFrame(one(model, *key, held), columns=["doc_id", "page", "batch", "response", "seconds", "error"])

    return dealt.mapInPandas(run, RAW)


def response_blocks(responses: DataFrame, sizes: DataFrame) -> DataFrame:
    """The blocks of all responses, as ``operators.blocks`` takes them; ``sizes`` is (doc_id, page, page_width, page_height)."""
    doc = F.try_parse_json("response")
    found = F.coalesce(*(F.try_variant_get(doc, p, "array<variant>") for p in ("$.res.parsing_res_list", "$.parsing_res_list", "$.blocks", "$[0].res.parsing_res_list", "$[0].parsing_res_list")))
    of = lambda keys, kind: F.coalesce(*(F.try_variant_get("b", f"$.{k}", kind) for k in keys))
    text = F.coalesce(*(F.nullif(F.trim(F.try_variant_get("b", f"$.{k}", "string")), F.lit("")) for k in TEXT))
    rows = responses.filter("error is null").select("doc_id", "page", F.try_variant_get(doc, "$.angle", "int").alias("angle"), F.posexplode(found).alias("block_no", "b"))
    return rows.select("doc_id", "page", "block_no", of(LABEL, "string").alias("label"), F.try_variant_get("b", "$.title_level", "int").alias("title_level"), text.alias("text"), of(BOX, "array<double>").alias("bbox"), of(ORDER, "int").alias("block_order"), F.coalesce("angle", F.lit(0)).alias("angle")).join(sizes, ["doc_id", "page"])


def same_runtime(expected: dict[str, str], actual: dict | None) -> bool:
    """Whether a worker's versions are those that were agreed on, each of them there."""
    return isinstance(actual, dict) and all(isinstance(actual.get(k), str) and actual[k].strip() == v for k, v in expected.items())


def base_address(value: str) -> str:
    """The address of a caption server without slash or /api at its end; only http and https, and no path."""
    from urllib.parse import urlparse

    clean = value.strip().rstrip("/").removesuffix("/api")
    url = urlparse(clean)
    if url.scheme not in ("http", "https") or not url.netloc or url.path not in ("", "/") or url.params or url.query or url.fragment:
        raise ValueError("the address must be http(s) without path, query or fragment")
    return clean


def pinned_model(tags: list[dict], model: str, digest: str) -> dict:
    """The one entry of a server's list that is the model with the agreed digest."""
    own = [t for t in tags if model in (t.get("name"), t.get("model"))]
    if len(own) != 1:
        raise ValueError(f"{len(own)} entries for model {model!r}, not one")
    found = str(own[0].get("digest", "")).removeprefix("sha256:").lower()
    if found != digest:
        raise ValueError(f"model {model!r} has digest {found!r}")
    return own[0]


def post_json(address: str, endpoint: str, payload: dict, seconds: float = 180.0) -> dict:
    """The JSON object that a server answers with."""
    import urllib.request

    request = urllib.request.Request(base_address(address) + endpoint, json.dumps(payload).encode(), {"Content-Type": "application/json"})  # noqa: S310 the scheme is checked
    with urllib.request.urlopen(request, timeout=seconds) as answer:  # noqa: S310
        out = json.loads(answer.read().decode())
    if not isinstance(out, dict):
        raise ValueError("the answer is no object")
    return out


def caption_request(model: str, prompt: str, image: bytes | None, parameters: dict) -> dict:
    """The body of one request: never streamed, the image in base64."""
    import base64

    body = {"model": model, "prompt": prompt, "stream": False, "options": {k: v for k, v in parameters.items() if k != "thinking"}, "think": bool(parameters.get("thinking"))}
    return body | ({"images": [base64.b64encode(image).decode()]} if image else {})
