"""Licence notices as they stand in files: wrapped, behind comment signs, with addresses and tags."""

import textwrap

from docgrid.llm import licenses

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Ann Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
CASES = {
    "GPL-3-or-later": GPL3, "GPL-2-or-later": GPL2, "Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "MPL-2.0": MPL,
    "AGPL-3-or-later": GPL3.replace("GNU General", "GNU Affero General"), "LGPL-3-or-later": GPL3.replace("GNU General", "GNU Lesser General"),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def forms(text):
    yield text
    yield textwrap.fill(text.replace("\n\n", "\0"), 60, replace_whitespace=True).replace("\0", "\n\n")
    yield "\n".join(f"# {line}".rstrip() for line in text.split("\n"))
    yield "/*\n" + "\n".join(f" * {line}" for line in text.split("\n")) + "\n */"
    yield "\n\n".join(" ".join(part.split()) for part in text.split("\n\n"))


def test_notices_in_all_forms(spark):
    rows = [(f"{name}|{k}", f"Some words before.\n\n{form}\n\nAnd more words after") for name, text in CASES.items() for k, form in enumerate(forms(text))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: got[k]["licenses"] for k, _ in rows if k in got} == {k: k.split("|")[0] for k, _ in rows}


def test_tags_references_and_edges(spark):
    texts = [
        "x\n// SPDX-License-Identifier: Apache-2.0\nint main;", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the MIT License\nand a next line", "Released under CC BY-NC 4.0",
        "no rights " * 20_000 + "\nLicensed under the Apache License, Version 2.0\n", "my license " * 3, None, "", "plain text",
    ]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[2])]
    out = licenses.scan(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, licenses int"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["licenses"]) for r in out.collect())
    assert got == [(-1, "MIT"), (0, "Apache-2.0"), (0, "Apache-2.0"), (1, "GPL-2.0-or-later"), (2, "MIT"), (3, "CC-BY-NC-4.0"), (4, "Apache-2.0"), (5, "")]
