from __future__ import annotations

import math
from collections import Counter

import pytest

from plumbline.llm.licences import LEAST, TEMPLATES, _anchors, _weights, _words, document_paths, scan

FILES = [
    ("src/LICENSE", "Released under the MIT License."),
    ("src/a/x.py", "code code\nmore of it"),
    ("src/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("src/a/b/deep/er/y.py", "nothing"),
    ("src/a/own.py", "# Licensed under the Apache License, Version 2.0. And more words follow here.\nx = 1"),
    ("src/ab/z.py", None),
    ("other/q", "this is it, and all of it"),
    ("top", ""),
    ("LICENCE-none", "no notice at all"),
    ("dup/LICENSE-b", "Licensed under CC BY-NC 4.0."),
    ("dup/LICENSE-a", "Licensed under CC BY-NC 4.0."),
    ("dup/f", "word " * 30_000),
    ("dup/f", "word " * 30_000),
]


def cosines(unit, files):
    df = Counter(w for _, t in files for w in set(_words(t or "")))
    n = len(files)
    idf = lambda w: math.log((n + 1) / ((df[w] if any(w in _words(t) for t in TEMPLATES.values()) else 0) + 1)) + 1
    a = Counter(_words(unit))
    out = {}
    for k, t in TEMPLATES.items():
        b = Counter(_words(t))
        dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
        norm = math.sqrt(sum((c * idf(w)) ** 2 for w, c in a.items()) * sum((c * idf(w)) ** 2 for w, c in b.items()))
        out[k] = dot / norm if norm else 0.0
    return out


def test_notices_and_inheritance(spark):
    got = {r.path: r for r in scan(spark.createDataFrame(FILES, "path string, text string")).collect()}
    assert len(got) == len({p for p, _ in FILES})
    seen = {p: (r.licence, r.how, r.origin) for p, r in got.items()}
    assert seen["src/LICENSE"] == ("MIT", "licence file", "src/LICENSE")
    assert seen["src/a/x.py"] == ("MIT", "inherited", "src/LICENSE")
    assert seen["src/a/b/deep/er/y.py"] == ("GPL-3.0", "inherited", "src/a/b/COPYING.txt")
    assert seen["src/a/own.py"] == ("Apache-2.0", "notice", "src/a/own.py")
    assert seen["src/ab/z.py"] == ("MIT", "inherited", "src/LICENSE")
    assert seen["dup/f"] == ("CC-BY-NC-4.0", "inherited", "dup/LICENSE-a")
    for p in ("other/q", "top", "LICENCE-none"):
        assert seen[p] == (None, "none", None)
    want = cosines("Licensed under the Apache License, Version 2.0.", FILES)
    assert got["src/a/own.py"].cosine == pytest.approx(want["Apache-2.0"], abs=0.05)
    assert got["src/LICENSE"].cosine == 1.0


def test_units_without_anchors_stay_below_the_limit():
    idf, _ = _weights(1000, {"the": 900, "is": 700, "this": 600, "or": 500, "and": 800, "of": 880})
    anchors = set(_anchors(idf))
    for t in TEMPLATES.values():
        b = Counter(_words(t))
        total = sum((c * idf[w]) ** 2 for w, c in b.items())
        rest = sum((c * idf[w]) ** 2 for w, c in b.items() if w not in anchors)
        assert rest < LEAST**2 * total


def test_odd_tables(spark):
    schema = "path string, text string, licence string, cosine int"
    assert scan(spark.createDataFrame([], schema)).count() == 0
    got = scan(spark.createDataFrame([(None, "Released under the MIT License.", "x", 1), ("/a//b", None, None, None), ("/LICENSE", "Released under the MIT License.", "y", 2)], schema)).collect()
    assert {r.path: r.licence for r in got} == {"/a//b": "MIT", "/LICENSE": "MIT"}


def test_document_paths(spark):
    df = spark.createDataFrame([(250, "x" * 500, "en", "s"), (7, None, None, "s")], "doc_id long, text string, lang string, source string")
    assert [r.path for r in document_paths(df).collect()] == ["s/en/2/250.txt", "s/-/LICENSE-7"]


GPL3_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
"""


def test_headers_names_and_tags(spark):
    want = {
        "a.py": (GPL3_HEADER, "GPL-3.0"),
        "b.c": (GPL3_HEADER.replace("# ", " * ").replace("General", "Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1"),
        "c.py": (GPL3_HEADER.replace("version 3", "version 2"), "GPL-2.0"),
        "d.py": ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"),
        "e.rs": ("// SPDX-License-Identifier: GPL-3.0-or-later\nfn main() {}", "GPL-3.0"),
        "f.rs": ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\nfn main() {}", "MIT OR Apache-2.0"),
        "g.md": ("This package is distributed under the terms of the MIT License, see the LICENSE file.", "MIT"),
        "h.md": ("Text of the pages: CC BY-SA 4.0", "CC-BY-SA-4.0"),
        "i.md": ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        "j.go": ('// Licensed under the Apache License,\n// Version 2.0 (the "License"); you may not use this file\n// except in compliance with the License.\npackage x', "Apache-2.0"),
        "k.js": ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nlet x", "MPL-2.0"),
        "l.py": ("# Not licensed under the MIT License.\nthe mit of it", None),
        "m.txt": ("The committee granted permission to the museum under the old terms.", None),
        "n.md": ("Released under the GNU Affero General Public License v3.0.", "AGPL-3.0"),
        "o.md": ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        "p.md": ("Licensed under the LGPL.", None),
    }
    got = {r.path: r.licence for r in scan(spark.createDataFrame([(p, t) for p, (t, _) in want.items()], "path string, text string")).collect()}
    assert got == {p: k for p, (_, k) in want.items()}


def test_real_licence_files(spark):
    from pathlib import Path

    import pyspark

    folder = Path(pyspark.__file__).parent / "licenses"
    want = {
        "bootstrap": "MIT", "dagre-d3": "MIT", "jquery": "MIT", "mustache": "MIT", "respond": "MIT", "sorttable.js": "MIT", "graphlib-dot": "MIT", "datatables": "MIT",
        "cloudpickle": "BSD-3-Clause", "py4j": "BSD-3-Clause", "join": "BSD-3-Clause", "sbt-launch-lib": "BSD-3-Clause",
        "d3.min.js": "ISC", "CC0": "CC0-1.0", "json-formatter": "Apache-2.0", "xz": "0BSD",
    }
    rows = [(f"{k}/{'LICENSE' if n % 2 else 'x.txt'}", (folder / f"LICENSE-{k}.txt").read_text(errors="replace")) for n, k in enumerate(want)]
    got = {r.path.split("/")[0]: r.licence for r in scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


def test_full_texts_say_themselves(spark):
    from plumbline.llm.licence_names import KEYS, full_texts

    texts = full_texts()
    assert set(texts) == set(KEYS)
    got = {r.path: r.licence for r in scan(spark.createDataFrame([(f"{k}/LICENSE", "Copyright (c) 2024 Some Body\n\n" + t) for k, t in texts.items()], "path string, text string")).collect()}
    assert got == {f"{k}/LICENSE": k for k in texts}
