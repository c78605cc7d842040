"""License scans by sentence rules; DataFrame functions only.

A text is cut into sentences at stops, blank lines and addresses, so that wrapped lines and lines
with comment signs read as one; each is normalised (lower case, letters and digits only, numbers read
as a version) and looked up among known licence sentences. Of a sentence that is not known, each
line is looked up by itself, as notices often stand on a line without a stop. The identifiers form a
sequence, and ordered rules claim runs of it, with up to ``GAP`` other identifiers between two that a
rule names: a rule that matches takes its identifiers away from later, weaker rules. Sentences that
speak of licences but are not known leave the mark UNKNOWN; copyright lines and addresses leave none.

Defined cases: null and empty texts give no row, nor do texts without a licence sentence; repeated
rows each give theirs; texts of any length are read as a whole; an empty table gives no rows; only id
and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other identifiers that may stand between two of a rule.
GAP = 2
#: Notices of well-known licences, as their owners ask for them to be written; {} is the version.
#: What follows the name are the sentences that are enough together, by number, for the rule without the rest.
_GPL = "the terms of the GNU {kind}General Public License as published by the Free Software Foundation"
_GPL_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    " See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this program."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
NOTICES = (
    ("Apache-{}", (0, 1), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at . Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-{}", (0,), "Apache License Version 2.0, January 2004. TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION."),
    ("MIT-0", (0, 1), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("MIT", (0, 1), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", (0,), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    *((f"{name}-{{}}{later}", (0, 1, 2)[:n], text + _GPL_REST.format(kind=kind))
      for name, kind in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero "))
      for later, n, text in (
          ("-or-later", 2, f"This program is free software: you can redistribute it and/or modify it under {_GPL.format(kind=kind)}, either version 3 of the License, or (at your option) any later version."),
          ("-or-later", 3, f"This program is free software; you can redistribute it and/or modify it under {_GPL.format(kind=kind)}; either version 2 of the License, or (at your option) any later version."),
          ("-only", 2, f"This program is free software: you can redistribute it and/or modify it under {_GPL.format(kind=kind)}, version 3."),
          ("-only", 3, f"This program is free software; you can redistribute it and/or modify it under {_GPL.format(kind=kind)}; version 2 of the License."),
      )),
    ("BSD-3-Clause", (0, 1, 2, 3), _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-2-Clause", (0, 1, 2), _BSD + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("MPL-{}", (0,), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at ."),
    ("EPL-{}", (0,), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at ."),
    ("BSL-{}", (0,), "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", (0, 1), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", (0,), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *((f"CC-{code}-{{}}", (0,), f"This work is licensed under {the}a Creative Commons {name} {version} {tail}.")
      for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for the, version, tail in (("", "4.0", "International License"), ("the terms of ", "4.0", "International License"), ("", "3.0", "Unported License"))),
    ("CC0-{}", (0,), "CC0 1.0 Universal."),
)
#: Names that short references use; "licensed under X", "released under X", "this work is licensed under X", with or without the article.
NAMES = {
    "apache license version #": "Apache-{}", "apache license #": "Apache-{}", "mit license": "MIT", "bsd license": "BSD", "isc license": "ISC",
    "bsd # clause license": "BSD-{}-Clause", "gnu general public license version #": "GPL-{}", "gnu general public license v#": "GPL-{}", "gnu gpl version #": "GPL-{}", "gpl version #": "GPL-{}",
    "gnu lesser general public license version #": "LGPL-{}", "gnu affero general public license version #": "AGPL-{}", "mozilla public license version #": "MPL-{}", "mozilla public license #": "MPL-{}", "eclipse public license version #": "EPL-{}",
    "cc by #": "CC-BY-{}", "cc by sa #": "CC-BY-SA-{}", "cc by nc #": "CC-BY-NC-{}", "cc by nd #": "CC-BY-ND-{}", "cc by nc sa #": "CC-BY-NC-SA-{}", "cc by nc nd #": "CC-BY-NC-ND-{}",
}
PREFIXES = ("licensed under ", "released under ", "this work is licensed under ", "distributed under ", "this software is licensed under ", "this project is licensed under ", "available under ")
#: Other sentences, and rules of their identifiers; the stronger rules stand first.
SENTENCES = {
    "mit license": "MitTitle", "the mit license": "MitTitle", "either version # of the license or at your option any later version": "OrLater", "or at your option any later version": "OrLater",
    "this work is released into the public domain": "PublicDomain", "all rights reserved": "AllRights",
}
OTHER_RULES = (("Public-Domain", ("PublicDomain",)), ("Proprietary", ("AllRights",)))
STOP = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|\n[^A-Za-z0-9\n]*(?=\n)"
#: "v. 2.0" is no stop.
SHORT = r"\b[vV]\.[\x20\t]+(?=[0-9])"
ADDRESS = r"<?https?://[^\x20\x09-\x0D<>]+>?"
SPDX = r"SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+)"
#: Words of which every known sentence has one, and those that make an unknown sentence a licence's.
KEYWORDS = "licen[sc]e|permission|copyright|warrant|gnu |redistribut|public domain|rights reserved|later version|software|creative commons|cc0|eclipse|cc by"
SPEAKS = "licen[sc]e|public domain|rights reserved"
VERSION = "[0-9]+( [0-9]+)*"


def plain_sentences(text: str) -> list[str]:
    """The normalised sentences of a notice, as ``scan`` cuts them."""
    parts = re.split(STOP, re.sub(ADDRESS, ". ", re.sub(SHORT, "version ", text)))
    names = (re.sub(r"[^a-z0-9]+", " ", p.lower()).strip() for p in parts)
    return [re.sub(VERSION, "#", n) for n in names if re.search("[a-z]", n)]


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifiers of the known sentences, and the rules: whole notices first, then their cores, then references."""
    known: dict[str, str] = dict(SENTENCES)
    whole, cores, references = [], [], []
    for n, (name, core, text) in enumerate(NOTICES):
        ids = [known.setdefault(s, f"N{n}.{k}") for k, s in enumerate(plain_sentences(text))]
        whole.append((name, tuple(ids)))
        cores.append((name, tuple(ids[k] for k in core if k < len(ids))))
    for k, (words, name) in enumerate(NAMES.items()):
        for prefix in PREFIXES:
            for the in ("", "the "):
                known.setdefault(prefix + the + words, f"R{k}")
        references.append((f"{name}-or-later", (f"R{k}", "OrLater")))
        references.append((name, (f"R{k}",)))
    whole.sort(key=lambda r: -len(r[1]))
    cores.sort(key=lambda r: -len(r[1]))
    later = [r for r in references if len(r[1]) == 2]
    return known, [*whole, *cores, *later, *(r for r in references if len(r[1]) == 1), ("MIT", ("MitTitle",)), ("{}", ("Spdx",)), *OTHER_RULES]


KNOWN, RULES = _tables()


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with licence sentences: id, licenses, n_licenses, identifiers, n_unknown."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.lower("_t").rlike(KEYWORDS + "|spdx"))
    # an SPDX tag is a sentence of its own, an address ends one
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_t"), SHORT, "version "), SPDX, ".\nSPDX-License-Identifier=$1;\n"), ADDRESS, ". ")
    docs = docs.select("_id", F.filter(F.split(text, STOP), lambda s: F.lower(s).rlike(KEYWORDS + "|spdx|compliance with|distributed|anyone is free|terms and conditions|neither the name|damages|redistribut")).alias("_s"))
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def found(raw: Column) -> Column:
        """The identifier of a piece of text, or null."""

        def of(s: Column) -> Column:
            one = F.try_element_at(known, F.regexp_replace(F.regexp_replace(s, f"^{VERSION} ", ""), VERSION, "#"))
            version = F.translate(F.regexp_extract(F.regexp_replace(s, f"^{VERSION} ", ""), VERSION, 0), " ", ".")
            return F.when(one.isNotNull(), F.concat(one, F.when(version != "", F.concat(F.lit("/"), version)).otherwise("")))

        tag = F.regexp_extract(raw, r"SPDX-License-Identifier=([A-Za-z0-9.+-]*[A-Za-z0-9+])", 1)
        return F.when(tag != "", F.concat(F.lit("Spdx/"), tag)).otherwise(let(normalised(raw), of))

    def names(raw: Column) -> Column:
        """The identifiers of a sentence: its own, else those of its lines, else UNKNOWN if it speaks of licences."""
        speaks = F.lower(raw).rlike(SPEAKS) & ~F.lower(raw).rlike(r"^[^a-z0-9]*copyright[^a-z]")

        def else_lines(one: Column) -> Column:
            lines = F.filter(F.transform(F.split(raw, "\n"), found), lambda x: x.isNotNull())
            lines = F.when(F.contains(raw, F.lit("\n")), lines).otherwise(F.array().cast("array<string>"))
            return F.when(one.isNotNull(), F.array(one)).otherwise(let(lines, lambda got: F.when(F.size(got) > 0, got).when(speaks, F.array(F.lit("UNKNOWN"))).otherwise(got)))

        return let(found(raw), else_lines)

    docs = docs.select("_id", F.flatten(F.transform("_s", names)).alias("_ids")).filter(F.size("_ids") > 0)
    docs = docs.withColumn("_seq", F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(",")))
    between = f"(?:,[^,]*,){{0,{GAP}}}?"
    runs = [(n, between.join(f",{re.escape(i)}(?:/([A-Za-z0-9.+-]+))?," for i in ids)) for n, ids in RULES if ids]
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(run).alias("run"), F.lit(f",{ids[0]}").alias("first")) for (n, run), ids in zip(runs, (i for _, i in RULES if i), strict=True)))
    rules = F.filter(rules, lambda r: F.contains(F.col("_seq"), r["first"]))

    def claim(acc: Column, rule: Column) -> Column:
        got = F.regexp_extract_all(acc["seq"], rule["run"], F.lit(0))
        told = F.transform(got, lambda m: F.rtrim(F.replace(rule["name"], F.lit("{}"), F.regexp_extract(m, "/([A-Za-z0-9.+-]+)", 1)), F.lit("-")))
        return F.struct(F.when(F.size(got) > 0, F.regexp_replace(acc["seq"], rule["run"], ",-,")).otherwise(acc["seq"]).alias("seq"), F.concat(acc["out"], told).alias("out"))

    start = F.struct(F.col("_seq").alias("seq"), F.array().cast("array<string>").alias("out"))
    docs = docs.withColumn("_got", F.aggregate(rules, start, claim)["out"])
    got = F.array_sort(F.array_distinct("_got"))
    return docs.select(
        F.col("_id").alias(id_col), F.array_join(got, ",").alias("licenses"), F.size("_got").cast("long").alias("n_licenses"), F.array_join("_ids", ",").alias("identifiers"),
        F.size(F.filter("_ids", lambda x: x == "UNKNOWN")).cast("long").alias("n_unknown"),
    )
