import re
from collections import Counter
from math import log, sqrt

from llm_fixtures import no_rows
from pyspark.sql import functions as F

from fieldpulse.llm.license import LICENSE_FILES, TEMPLATES, license_of_files

WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the \"Software\"), to deal in the Software without restriction"
ROWS = [
    ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "nothing"), ("a/b/y.py", "text\n# Licensed under the Apache License, Version 2.0.\nmore"),
    ("a/b/COPYING.txt", "intro\n\nThis work is licensed under the GNU General Public License, version 3."), ("top.txt", None), ("", ""), (None, "All rights reserved."),
    ("d/LICENSE-MIT", MIT), ("d/LICENSE-APACHE", "Licensed under the Apache License, Version 2.0."), ("d/z.txt", "Licensed under a licence of my own making, version 9"),
    ("e/license_notes", "Released under the MIT License."), ("e/f.txt", ""), ("q/r", "/* Licensed under CC BY-NC 4.0. */"), ("q/r", "again"),
    ("s/t.txt", "Licensed under the Apache License Version 2.0 with some words"), ("a/long.txt", "x " * 30_000), ("/abs/LICENSE", "All rights reserved."), ("/abs/v/w", "w"),
]


def passages(text, whole):
    out, every = [], []
    for paragraph in re.split(r"\n[^\S\n]*\n", text.lower()):
        lines = [w for w in map(WORD.findall, paragraph.split("\n")) if w]
        out += lines + ([[w for x in lines for w in x]] if len(lines) > 1 else [])
        every += [w for x in lines for w in x]
    return out + ([every] if whole else [])


def expected():
    files = [(p or "", t or "") for p, t in ROWS]
    named = {p: bool(re.match(LICENSE_FILES, p.split("/")[-1].lower())) for p, _ in files}
    spelled = [(p, w) for p, t in files for w in passages(t, named[p])]
    templates = [(name, Counter(WORD.findall(t.lower()))) for name, texts in TEMPLATES.items() for t in texts]
    numbers = lambda c: {w for w in c if re.fullmatch(r"[0-9.]+", w)}
    known = {w for _, c in templates for w in c}
    df = Counter(w for _, words in spelled for w in set(words) & known)
    weigh = lambda c: {w: n * (log((1 + len(spelled)) / (1 + (df[w] if w in known else 0))) + 1) for w, n in c.items()}
    norm = lambda v: sqrt(sum(x * x for x in v.values()))
    own = {}
    for p, words in spelled:
        v, near = weigh(Counter(words)), {}
        for name, c in templates:
            u = weigh(c)
            cos = round(sum(v[w] * u.get(w, 0) for w in v) / (norm(v) * norm(u)), 9) if v else 0
            if cos >= 0.8 and numbers(c) <= set(words):
                near[name] = max(near.get(name, 0), cos)
        ranked = sorted(((-cos, name) for name, cos in near.items()))
        if ranked and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= 0.002):
            own[p] = min(own.get(p, (0, "")), ranked[0])
    granted = {}
    for p, best in own.items():
        if named[p]:
            d = p.rpartition("/")[0]
            granted[d] = min(granted.get(d, best), best)
    out = {}
    for p in {p for p, _ in files}:
        d, up = p.rpartition("/")[0], None
        parts = d.split("/")
        for n in range(len(parts), -1, -1):
            if (at := "/".join(parts[:n])) in granted:
                up = at
                break
        mine = own.get(p, (None, None))[1]
        out[p] = (mine, mine or (granted[up][1] if up is not None else None), None if mine else up)
    return out


def test_notices_and_inheritance_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, "path string, text string").withColumn("dir", F.lit(1)).withColumn("license", F.lit(1))
    got = license_of_files(df)
    assert got.columns == ["path", "own_license", "cosine", "license", "inherited_from"]
    found = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in got.collect()}
    assert found == expected()
    assert found["a/b/c/x.py"] == (None, "GPL-3.0", "a/b") and found["a/b/y.py"][0] == "Apache-2.0" and found["a/long.txt"] == (None, "MIT", "a")
    assert found["d/z.txt"][1] in ("MIT", "Apache-2.0") and found["e/f.txt"] == (None, None, None) and found["/abs/v/w"][1] == "Proprietary"
    assert license_of_files(no_rows(df)).count() == 0


# Licence files and headers as projects have them, put together apart from the templates.
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
KEEP = "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL = """ * This program is free software{c} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version {v} of the License, or
 * (at your option) any later version."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
OWNER = "Copyright (c) 2021, The Example Authors"
REAL = {
    "mit/LICENSE": ("MIT", "\n\n".join(["MIT License", OWNER, GRANT, KEEP])),
    "mit2/MIT-LICENSE.txt": ("MIT", "\n\n".join([OWNER, GRANT, KEEP])),
    "bsd2/LICENSE": ("BSD-2-Clause", "\n\n".join([OWNER, CLAUSES, AS_IS])),
    "bsd3/LICENSE.md": ("BSD-3-Clause", "\n\n".join([OWNER, CLAUSES, THIRD, AS_IS])),
    "isc/LICENSE": ("ISC", "\n\n".join(["ISC License", OWNER, ISC])),
    "gpl2/COPYING": ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone is permitted to copy"),
    "gpl3/COPYING": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy"),
    "src/two.c": ("GPL-2.0", "/*\n" + GPL.format(v=2, c=";") + "\n */\n\nint main() {}"),
    "src/three.c": ("GPL-3.0", "/*\n" + GPL.format(v=3, c=":") + "\n */\n\nint main() {}"),
    "src/a.py": ("Apache-2.0", APACHE + "\n\nimport os"),
}


def test_real_files_and_headers_are_told_apart(spark):
    """As they are, and with one word changed; a version that no licence has is none."""
    for change in ("", "Software", "redistribute", "permitted", "copy"):
        texts = {p: re.sub(rf"\b{change}\b", "artefact", t, count=1, flags=re.I) if change else t for p, (_, t) in REAL.items()}
        rows = [*texts.items(), *((f"{p.split('/')[0]}/x/y.txt", "nothing here") for p in texts if not p.startswith("src"))]
        rows += [("src/nine.c", GPL.format(v=9, c=":")), *((f"other/{n}", f"words of file {n}") for n in range(300))]
        found = {r["path"]: r for r in license_of_files(spark.createDataFrame(rows, "path string, text string")).collect()}
        assert {p: found[p]["own_license"] for p in REAL} == {p: name for p, (name, _) in REAL.items()}, change
        for p, (name, _) in REAL.items():
            if not p.startswith("src"):
                assert found[f"{p.split('/')[0]}/x/y.txt"]["license"] == name
        assert found["src/nine.c"]["license"] is None
