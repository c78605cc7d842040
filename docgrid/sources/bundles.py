"""Bundles of finished documents: one folder a document with run.json, manual.json and toc.json.

Reading keeps errors as values: a file that is missing, no JSON or of another shape gives a row
that says so, and never ends the job. A manual is a tree; it is flattened in Arrow batches, one
document at a time, and its elements are read from JSON by columns.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

RUN = "run_id string, status string, source struct<file:string,sha256:string,size_bytes:bigint,pages_total:int,detected:struct<profile:string,embedded_outline:boolean,outline_entries:int,text_layer:boolean,sampled_pages:array<int>,pages_with_text:int,median_text_characters:double,profile_confidence:double>>, pipeline struct<profile:string,parser:string,structure_strategy:string,enrichment_provider:string,enrichment_model:string>"
TOC = "array<struct<level:int,title:string,page:int,confidence:double>>"
META = "title string, source_file string, language string, metadata struct<pages_total:int,pages_processed:array<int>,profile:string,parser:string,structure_strategy:string,toc_available:boolean>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
ELEMENT = f"source struct<page:int,page_size:struct<width:double,height:double>,bbox:{BOX},rotation:double>, text string, image_path string, table_image_path string, table_markdown string, caption_original string, caption_generated string, trace struct<reading_order:int,parent_chapter_id:string,role:string,heading_level:int,include_in_rag:boolean,exclusion_reason:string>"
_INTS, _TEXTS = ("pos", "chapter", "parent", "level", "page", "child_pos"), ("kind", "id", "title", "parent_id", "body")
NODES = ArrayType(StructType([*(StructField(n, IntegerType()) for n in _INTS), *(StructField(n, StringType()) for n in _TEXTS)]))
FILES = ("run.json", "manual.json", "toc.json")


def flatten_manual(text: str | None) -> list[dict] | None:
    """Nodes of a manual in preorder; None where the text holds no tree of nodes.

    ``pos`` counts all nodes, ``chapter`` the chapters; ``parent`` is the chapter that holds a node.
    """
    try:
        stack = [(node, None, None, i) for i, node in reversed(list(enumerate(json.loads(text or "")["content"])))]
        out, chapters = [], 0
        while stack:
            node, parent, parent_id, place = stack.pop()
            inner = node["type"] == "chapter"
            own = chapters if inner else None
            out.append({"pos": len(out), "chapter": own, "parent": parent, "level": node.get("level"), "page": node["page"], "child_pos": place, "kind": node["type"], "id": node["id"], "title": node.get("title"), "parent_id": parent_id, "body": None if inner else json.dumps(node)})
            if inner:
                chapters += 1
                stack.extend((child, own, node["id"], i) for i, child in reversed(list(enumerate(node["content"]))))
        return out
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


@F.pandas_udf(NODES)
def manual_nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(flatten_manual)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, run, manual, toc) texts of the bundles under ``root``; null where a file is missing."""
    found = spark.read.option("wholetext", True).option("pathGlobFilter", "{run,manual,toc}.json").option("recursiveFileLookup", True).text(root)
    at = F.split(F.col("_metadata.file_path"), "/")
    found = found.select(F.url_decode(F.element_at(at, -2)).alias("doc_id"), F.element_at(at, -1).alias("name"), "value")
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return found.groupBy("doc_id").agg(*(pick(n).alias(n.removesuffix(".json")) for n in FILES))


def file_checks(files: DataFrame) -> DataFrame:
    """(doc_id, check_id, passed): each file is there, is JSON, and has the shape of its contract."""
    shape = {"run": F.from_json("run", RUN)["source"]["pages_total"].isNotNull(), "manual": manual_nodes("manual").isNotNull(), "toc": F.from_json("toc", TOC, {"mode": "PERMISSIVE"}).isNotNull()}
    rows = []
    for name in shape:
        for what, ok in (("exists", F.col(name).isNotNull()), ("json", F.try_parse_json(name).isNotNull()), ("contract", F.col(f"_{name}"))):
            rows.append(F.struct(F.lit(f"{'manifest' if name == 'run' else name}.{what}").alias("check_id"), F.coalesce(ok, F.lit(False)).alias("passed")))
    seen = files.select("*", *(c.alias(f"_{n}") for n, c in shape.items()))
    return seen.select("doc_id", F.explode(F.array(*rows)).alias("c")).select("doc_id", "c.*")


def runs(files: DataFrame) -> DataFrame:
    """(doc_id, run_id, status, pages_total, pages_processed, ...) of bundles whose manifest can be read."""
    r = files.select("doc_id", F.from_json("run", RUN).alias("r"), F.from_json("manual", META).alias("m")).filter("r.source.pages_total is not null")
    return r.select("doc_id", "r.run_id", "r.status", "r.source.pages_total", F.coalesce("m.metadata.pages_processed", F.array().cast("array<int>")).alias("pages_processed"), "r.pipeline.profile", "r.pipeline.parser", F.col("r.pipeline.structure_strategy").alias("strategy"), F.col("r.source.detected.embedded_outline").alias("has_outline"), F.col("m.title").alias("manual_title"))


def toc(files: DataFrame) -> DataFrame:
    rows = files.select("doc_id", F.posexplode(F.from_json("toc", TOC)).alias("ord", "t"))
    return rows.select("doc_id", "ord", "t.*")


def nodes(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.explode(manual_nodes("manual")).alias("n")).select("doc_id", "n.*")


def chapters(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'chapter'").select("doc_id", F.col("chapter").alias("ord"), F.col("id").alias("chapter_id"), F.col("parent").alias("parent_ord"), "parent_id", "level", "title", "page", "child_pos")


def elements(nodes: DataFrame) -> DataFrame:
    e = nodes.filter("kind <> 'chapter'").withColumn("b", F.from_json("body", ELEMENT))
    return e.select("doc_id", F.col("id").alias("element_id"), F.col("kind").alias("type"), "page", "pos", "child_pos", F.col("parent").alias("chapter_ord"), "parent_id", "b.*")


def fingerprint_files(spark: SparkSession, root: str, doc_id: Column | None = None) -> DataFrame:
    """(doc_id, path, content) of all files of the bundles right under ``root``, for the fingerprint."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace(F.url_decode("path"), r"^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    parts = F.split(F.substring(inner, F.lit(len(base) + 1), F.length(inner)), "/", 2)
    return found.select(F.get(parts, F.lit(0)).alias("doc_id"), F.get(parts, F.lit(1)).alias("path"), "content").filter("path is not null")


def write_bundles(files: DataFrame, root: str) -> DataFrame:
    """Publishes the files (doc_id, path, content) of each document as a folder of ``root``, which all executors share.

    Gives (doc_id, state): published, or unchanged where the folder holds these files already (as
    after a task that ran twice), or exists where it holds others, which are never replaced, or
    unsafe where the id or a path would leave the root. A folder is written beside its place and
    renamed once, so a lost executor leaves no part of it. Nothing is written before an action.
    """

    def publish(frame: pd.DataFrame) -> pd.DataFrame:
        doc = str(frame["doc_id"].iloc[0])
        inside = lambda p: bool(p) and not os.path.isabs(p) and ".." not in p.replace("\\", "/").split("/") and "\0" not in p
        target = os.path.join(root, doc)
        if doc in ("", ".", "..") or "/" in doc or "\\" in doc or not all(map(inside, frame["path"])):
            state = "unsafe"
        elif os.path.isdir(target):
            state = "unchanged" if _held(target) == {os.path.normpath(p): c.encode() for p, c in zip(frame["path"], frame["content"], strict=True)} else "exists"
        else:
            staging = os.path.join(root, f".{doc}.{uuid.uuid4().hex}")
            for path, content in zip(frame["path"], frame["content"], strict=True):
                at = os.path.join(staging, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(content.encode())
            try:
                os.rename(staging, target)
                state = "published"
            except OSError:
                shutil.rmtree(staging, ignore_errors=True)
                if not os.path.isdir(target):
                    raise
                state = "exists"
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1], "state": [state]})

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "path", F.coalesce("content", F.lit("")).alias("content")).groupBy("doc_id").applyInPandas(publish, f"doc_id {kind}, state string")


def _held(folder: str) -> dict[str, bytes]:
    out = {}
    for at, _, names in os.walk(folder):
        for name in names:
            with open(os.path.join(at, name), "rb") as f:
                out[os.path.relpath(os.path.join(at, name), folder)] = f.read()
    return out


def toc_file(toc: DataFrame) -> DataFrame:
    """toc.json of each document as (doc_id, path, content)."""
    entry = F.struct("ord", F.struct("level", "title", "page", "confidence").alias("e"))
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"])
    return toc.groupBy("doc_id").agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("content")).select("doc_id", F.lit("toc.json").alias("path"), "content")
