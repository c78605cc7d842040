"""Commands over folders: ``detect`` profiles of files, ``validate`` bundles, print a ``schema``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docgrid.operators import detect
from docgrid.sources import bundles, pdf

SCHEMAS = {"manual": bundles.ELEMENT, "run": bundles.RUN, "toc": bundles.TOC}


def _detect(spark: SparkSession, folder: str) -> int:
    reader = pdf.installed_reader()
    if reader is None:
        print("no library for PDF files is installed", file=sys.stderr)
        return 2
    for row in detect.detect_profile(*pdf.capabilities(pdf.listed(spark, folder), reader)).toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


def _validate(spark: SparkSession, folder: str) -> int:
    failed = bundles.file_checks(bundles.read_files(spark, folder)).filter(~F.col("passed")).orderBy("doc_id", "check_id")
    n = 0
    for row in failed.toLocalIterator():
        print(f"{row.doc_id}\t{row.check_id}")
        n += 1
    return int(n > 0)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docgrid", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("detect", "validate"):
        commands.add_parser(name).add_argument("folder")
    commands.add_parser("schema").add_argument("name", choices=sorted(SCHEMAS))
    given = parser.parse_args(arguments)
    if given.command == "schema":
        from pyspark.sql.types import StructType

        schema = SCHEMAS[given.name]
        print(schema.json() if isinstance(schema, StructType) else schema)
        return 0
    spark = SparkSession.builder.getOrCreate()
    return {"detect": _detect, "validate": _validate}[given.command](spark, given.folder)


if __name__ == "__main__":
    sys.exit(main())
