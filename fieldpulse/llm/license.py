"""License scans: TF-IDF cosine to notice templates, then inheritance from the nearest directory."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Mapping, Sequence
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.rows import map_texts, text_or_empty
from fieldpulse.runtime import as_table

MIN_COSINE = 0.8
LICENSE_FILES = r"^([a-z0-9.]+-)?((un)?licen[sc]es?|copying)([.-].*)?$"
# Of two licences whose closeness to a passage differs by less, neither is taken for the other.
MARGIN = 0.002

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(thing: str, kind: str, version: str, colon: str) -> str:
    """The header that the GNU licences ask for, by kind and version."""
    return (
        f"This {thing} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} "
        f"License as published by the Free Software Foundation; either version {version} of the License, or (at your "
        "option) any later version."
    )


# Titles, headers and defining paragraphs of the licences, and the usual short notices. Numbers that
# a notice holds must stand in a passage too; clauses are given without theirs.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        _MIT,
        _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        _BSD, _BSD + _BSD_END,
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        _BSD + _BSD_NAMES, _BSD + _BSD_NAMES + _BSD_END,
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _gnu("program", "General Public", "3", ":"),
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        _gnu("program", "General Public", "2", ";"),
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _gnu("library", "Lesser General Public", "3", ":"),
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        _gnu("library", "Lesser General Public", "2.1", ";"),
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        _gnu("program", "Affero General Public", "3", ":"),
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
}

_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_NUMBER = r"[0-9]+(?:[.][0-9]+)*"


def _terms(text: str) -> list[str]:
    import re

    return re.findall(_WORD, text.lower())


def _passages(text: str, whole: bool) -> Iterator[list[str]]:
    """Words of every line, of every paragraph of several lines, and of a whole licence file."""
    import re

    word = re.compile(_WORD)
    every: list[str] = []
    for paragraph in re.split(r"\n[^\S\n]*\n", text.lower()):
        lines = [w for w in map(word.findall, paragraph.split("\n")) if w]
        yield from lines
        if len(lines) > 1:
            yield [w for line in lines for w in line]
        if whole:
            every += (w for line in lines for w in line)
    if whole:
        yield every


def _counts(files: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``(term, n)``: passages that hold each template term; the empty term counts all passages."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = {t: k for k, t in enumerate(vocabulary)}
        seen, total = array("q", bytes(8 * len(known))), 0
        for batch in batches:
            for text, whole in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                for words in _passages(text.as_py(), whole):
                    total += 1
                    for k in {known[w] for w in words if w in known}:
                        seen[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary, ""]), pa.array([*seen, total], pa.int64())], ["term", "n"])

    return map_texts(files, run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _candidates(files: DataFrame, weight: dict[str, float], unknown: float, min_cosine: float) -> DataFrame:
    """Passages whose template terms carry enough of their norm to reach ``min_cosine`` at all."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter
        from math import sqrt

        import pyarrow as pa

        # The cosine is at most the share of the norm that template terms carry.
        need = min_cosine * min_cosine
        kind = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
        for batch in batches:
            rows: list[tuple] = []
            for file, text, whole in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for n, words in enumerate(_passages(text.as_py(), whole)):
                    held = [weight[w] for w in words if w in weight]
                    if not held:
                        continue
                    # Bounds from both sides without counting words: known at most, unknown at least.
                    most = sum(held) ** 2
                    if most * (1 - need) < need * (len(words) - len(held)) * unknown * unknown:
                        continue
                    tf = Counter(words)
                    known = sum((c * weight[w]) ** 2 for w, c in tf.items() if w in weight)
                    norm = known + sum((c * unknown) ** 2 for w, c in tf.items() if w not in weight)
                    if known < need * norm * (1 - 1e-9):
                        continue
                    rows.append((file, n, sqrt(norm), [{"term": w, "w": c * weight[w]} for w, c in tf.items() if w in weight]))
            files_, passages, norms, terms = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(files_, pa.string()), pa.array(passages, pa.int32()), pa.array(norms, pa.float64()), pa.array(terms, kind)],
                ["path", "passage", "norm", "terms"],
            )

    return map_texts(files, run, "path string, passage int, norm double, terms array<struct<term: string, w: double>>")


def notices(files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, min_cosine: float = MIN_COSINE,
            margin: float = MARGIN) -> DataFrame:
    """``(path, license, cosine)`` of each file with a passage near a template; ties go to the smaller name.

    A passage must hold the numbers of a template, so no version is taken for another. A passage
    goes to the closest licence; it says nothing if a second one is closer than ``margin`` to the first.
    ``files`` is ``(path, text, whole)``. Terms are weighted by count times ``ln((1+N)/(1+n)) + 1``
    with ``n`` of all ``N`` passages of the corpus holding the term; a term of no template weighs as
    one that no passage holds, so foreign words always lower the cosine.
    """
    spark = files.sparkSession
    import re

    spelled = [(name, k, _terms(t)) for name, texts in templates.items() for k, t in enumerate(texts)]
    vocabulary = sorted({w for _, _, words in spelled for w in words})
    # One number per template term, whatever the size of the corpus.
    held = {r["term"]: r["n"] for r in _counts(files, vocabulary).collect()}
    total = held.pop("", 0)
    weight = {t: log((1 + total) / (1 + held.get(t, 0))) + 1 for t in vocabulary}
    rows = []
    for name, k, words in spelled:
        counted = {w: words.count(w) * weight[w] for w in words}
        norm = sum(v * v for v in counted.values()) ** 0.5
        numbers = {w for w in counted if re.fullmatch(_NUMBER, w)}
        rows += [(name, k, w, v / norm, w in numbers, len(numbers)) for w, v in counted.items()]
    vectors = F.broadcast(spark.createDataFrame(
        rows, "license string, template int, term string, unit double, number boolean, numbers int"
    ))
    found = _candidates(files, weight, log(1 + total) + 1, min_cosine)
    cosine = F.sum(F.col("w") * F.col("unit")) / F.first("norm")
    near = (
        found.select("path", "passage", "norm", F.inline("terms")).join(vectors, "term")
        .groupBy("path", "passage", "license", "template")
        .agg(F.round(cosine, 9).alias("cosine"), F.count_if("number").alias("held"), F.first("numbers").alias("numbers"))
        .filter((F.col("cosine") >= min_cosine) & (F.col("held") == F.col("numbers")))
        .groupBy("path", "passage", "license").agg(F.max("cosine").alias("cosine"))
    )
    # Few licences are near to one passage.
    ranked = near.groupBy("path", "passage").agg(F.sort_array(F.collect_list(F.struct("cosine", "license")), False).alias("r"))
    clear = (F.size("r") < 2) | (F.try_element_at("r", F.lit(1))["cosine"] - F.try_element_at("r", F.lit(2))["cosine"] >= margin)
    best = ranked.filter(clear).select("path", F.col("r")[0]["license"].alias("license"), F.col("r")[0]["cosine"].alias("cosine"))
    return best.groupBy("path").agg(F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), "license")).alias("b")).select("path", "b.*")


def license_of_files(docs: DataFrame, path_col: str = "path", text_col: str = "text",
                     templates: Mapping[str, Sequence[str]] = TEMPLATES, min_cosine: float = MIN_COSINE,
                     license_files: str = LICENSE_FILES) -> DataFrame:
    """One row per distinct path: ``(path, own_license, cosine, license, inherited_from)``.

    A notice in the file itself decides. A file without one takes the license of the nearest
    directory at or above it that has a licence file (by name) with a recognised notice; ``inherited_from`` is that
    directory. Of several licence files in a directory the closest match decides, then the smaller
    license name. Null paths count as the empty path and null texts as empty; rows that repeat a
    path are passages of one file. Other columns are ignored; an empty table gives no rows.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    base = F.lower(F.substring_index(path, "/", -1))
    files = docs.select(path.alias("path"), text_or_empty(text_col).alias("text"), base.rlike(license_files).alias("whole"))
    own = as_table(notices(files, templates, min_cosine), "license-own")

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    names = as_table(files.select("path").distinct().withColumn("dir", folder), "license-paths")
    granted = as_table(
        own.filter(F.lower(F.substring_index("path", "/", -1)).rlike(license_files)).withColumn("dir", folder)
        .groupBy("dir").agg(F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("granted")),
        "license-directories",
    )
    # Directories, not files, look for their ancestors: a folder of very many files asks once.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = names.select("dir").distinct()
    nearest = as_table(
        folders.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "up"))
        .join(granted.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir").agg(F.max(F.struct("depth", "up", "granted")).alias("n")).select("dir", "n.up", "n.granted"),
        "license-nearest",
    )
    joined = names.join(own.withColumnRenamed("license", "own_license"), "path", "left").join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull()
    return joined.select(
        F.col("path").alias(path_col), "own_license", "cosine",
        F.coalesce("own_license", "granted").alias("license"), F.when(inherits, F.col("up")).alias("inherited_from"),
    )
