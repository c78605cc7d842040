"""Files of pages as relations: a Spark data source that reads one file a task, with the reader injected.

A reader is ``read(path: str) -> Mapping`` with pages (a list of (width, height, lines), a line
being (text spans, box)), a span (text, size, font); outline (a list of (level, title, page)); labels
(a list of (start page, prefix, first number, style)); title. It runs on the executors and is
shipped with the plan, so that no library for files is a requirement here. What a reader raises
becomes a row with an error, and the other files are read on.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Reader = Callable[[str], Mapping]
LINES = "source string, page int, line_no int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, font_name string, page_width double, page_height double, error string"
OUTLINE = "source string, ord int, level int, title string, page int, confidence double, pages_total int, document_title string, error string"
LABELS = "source string, seg int, start_page int, prefix string, first_number int, style string, pages_total int, error string"


def documents(paths: DataFrame, files_per_task: int = 1) -> DataFrame:
    """``paths`` (source) dealt out so that a task opens ``files_per_task`` files."""
    n = max(1, paths.count() // files_per_task)
    return paths.select("source").repartition(n, "source")


def line_of(spans: Sequence[tuple[str, float, str]]) -> tuple[str, float, str]:
    """The text of a line's spans, joined by one space, in compatible form; the largest size; the first font."""
    words = [s for s in (t.strip() for t, _, _ in spans) if s]
    return unicodedata.normalize("NFKC", " ".join(" ".join(words).split())), max((float(size) for _, size, _ in spans), default=0.0), next((f for _, _, f in spans if f), "")


def _rows_of(make: Callable[[str, Mapping], Iterator[tuple]], reader: Reader, width: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source in frame["source"]:
                try:
                    if not str(source).lower().endswith(".pdf"):
                        raise ValueError("not a PDF file")
                    found = reader(source)
                    if found.get("encrypted"):
                        raise ValueError("the file is encrypted")
                    if not found["pages"]:
                        raise ValueError("the file has no pages")
                    out = [(*row, None) for row in make(source, found)]
                except Exception as error:  # noqa: BLE001 a file that cannot be read is a row
                    out = [(source, *[None] * (width - 2), f"{type(error).__name__}: {error}"[:4000])]
                if out:
                    yield pd.DataFrame(out, dtype=object)

    return rows


def _lines(source: str, found: Mapping) -> Iterator[tuple]:
    for page, (wide, high, lines) in enumerate(found["pages"], 1):
        number = 0
        for spans, box in lines:
            text, size, font = line_of(spans)
            if text:
                yield source, page, number, text, dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True)) if box else None, size, font, float(wide), float(high)
                number += 1


def _outline(source: str, found: Mapping) -> Iterator[tuple]:
    title = (found.get("title") or "").strip() or None
    entries = [(level, " ".join(str(name).split()), page) for level, name, page in found.get("outline") or []]
    for level, name, page in entries:
        if level < 1 or page < 1 or not name:
            raise ValueError(f"outline entry {name!r} at level {level} points to page {page}")
    for ord_, (level, name, page) in enumerate(entries):
        yield source, ord_, level, name, page, 1.0, len(found["pages"]), title


def _labels(source: str, found: Mapping) -> Iterator[tuple]:
    for seg, (start, prefix, first, style) in enumerate(sorted(found.get("labels") or [], key=lambda x: x[0])):
        yield source, seg, start, prefix or "", first, style or "", len(found["pages"])


def _read(paths: DataFrame, make, reader: Reader, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.replace("struct<x0:double,y0:double,x1:double,y1:double>", "box").split(", ")]
    rows = _rows_of(make, reader, len(names))

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows(frames):
            frame.columns = names
            yield frame

    return documents(paths).mapInPandas(named, schema)


def read_lines(paths: DataFrame, reader: Reader) -> DataFrame:
    """The text lines of all pages, with layout, in the order of the files' content."""
    return _read(paths, _lines, reader, LINES)


def read_outline(paths: DataFrame, reader: Reader) -> DataFrame:
    """Bookmarks with confidence 1; a file whose bookmarks point nowhere is an error row."""
    return _read(paths, _outline, reader, OUTLINE)


def read_labels(paths: DataFrame, reader: Reader) -> DataFrame:
    """Ranges of printed page numbers: each ends before the next begins, the last with the document."""
    order = W.partitionBy("source").orderBy("seg")
    labels = _read(paths, _labels, reader, LABELS)
    return labels.withColumn("end_page", F.coalesce(F.lead("start_page").over(order) - 1, F.col("pages_total")))


def capabilities(paths: DataFrame, reader: Reader) -> tuple[DataFrame, DataFrame]:
    """(pages, outlines) as the detection of profiles takes them: (doc_id, page, chars) and (doc_id, has_outline)."""
    from docgrid.operators.detect import page_characters

    def pages(source: str, found: Mapping) -> Iterator[tuple]:
        for page, (_, _, lines) in enumerate(found["pages"], 1):
            yield source, page, "\n".join(line_of(spans)[0] for spans, _ in lines), bool(found.get("outline"))

    rows = _read(paths, pages, reader, "source string, page int, text string, has_outline boolean, error string").filter("error is null").withColumnRenamed("source", "doc_id")
    return page_characters(rows), rows.groupBy("doc_id").agg(F.bool_or("has_outline").alias("has_outline"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(source) of the files below a folder, by Spark's own listing: the bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("source"))


def installed_reader() -> Reader | None:
    """A reader by a library for PDF files where one is installed, else None."""
    try:
        import pymupdf
    except ImportError:
        return None

    def read(path: str) -> Mapping:
        with pymupdf.open(path.removeprefix("file:") if os.path.sep in path else path) as doc:
            if doc.needs_pass:
                return {"encrypted": True, "pages": []}
            pages = []
            for page in doc:
                lines = [([(s["text"], s["size"], s["font"]) for s in line["spans"]], line["bbox"]) for block in page.get_text("dict")["blocks"] for line in block.get("lines", ())]
                pages.append((page.rect.width, page.rect.height, lines))
            labels = [(r["startpage"] + 1, r.get("prefix", ""), r.get("firstpagenum", 1), r.get("style", "")) for r in doc.get_page_labels()]
            return {"pages": pages, "outline": [tuple(e[:3]) for e in doc.get_toc(simple=True)], "labels": labels, "title": (doc.metadata or {}).get("title")}

    return read
