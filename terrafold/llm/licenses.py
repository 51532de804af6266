"""License scans: MinHash bands over overlapping windows of a text retrieve templates, containment of shingles verifies them.

Templates are grouped by their number of shingles (5 words each), rounded up to a power of two c. Windows of 2c shingles
that begin every c shingles cover any occurrence of a template of at most c shingles, so a window that holds a template
with a containment of at least 0.8 has a Jaccard similarity of at least about 0.2 with it. Bands have one row each, and
so many of them that a template is missed with a probability of at most 0.1 %. What the bands retrieve is verified by the exact containment in the window and a window's length on both sides.

Only DataFrame functions are used. Every text that holds a template has one of a few words (see hitting_set()); a text
without them has no windows to hash, and nothing is lost.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import texts

SHINGLE, LEAST = 5, 0.8
#: Notices in their usual words, and whole texts of short licenses without their copyright lines. What
#: several licenses share is named a notice; a clause that tells two apart has the name of the one that has it.
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": _REDISTRIBUTION,
    "bsd-text": f"{_REDISTRIBUTION}: {_CONDITIONS} {_AS_IS}",
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software,"
        " and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": _ISC,
    "isc-text": (
        f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,"
        " ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "mit-notice": _MIT,
    "mit-text": (
        f"{_MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,"
        " and to alter it and redistribute it freely, subject to the following restrictions"
    ),
}


#: Words that are frequent in any text; the hitting set takes them only if a shingle has no other.
COMMON = frozenset("a an and any are as at be by file for from in is it may not of on or such that the this to under use with you".split())


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def hitting_set(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words of which every text that holds a template has one.

    Such a text lacks at most a fifth of the template's shingles, so it is enough that the words are in more shingles
    than that; long words that aren't frequent in any text come first.
    """
    grams = [{tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} for t in templates.values() if (w := template_words(t))]
    need = [len(g) - math.ceil(least * len(g) - 1e-9) + 1 for g in grams]
    out: list[str] = []
    while any(n > 0 for n in need):
        left = [s for g, n in zip(grams, need) if n > 0 for s in g]
        best = max(sorted({w for s in left for w in s}), key=lambda w: (w not in COMMON, min(len(w), 7), sum(w in s for s in left), len(w), w))
        out.append(best)
        for k, g in enumerate(grams):
            hit = {s for s in g if best in s}
            need[k] -= len(hit)
            g -= hit
    return out


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def shingles_of(words: Column) -> Column:
    """Hashes of the shingles in order; of all words as one if there are fewer than five."""
    n = F.greatest(F.size(words) - F.lit(SHINGLE - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))


def bands(c: int, least: float = LEAST) -> int:
    """Bands that miss a template of size c in the window that covers it with a probability of 0.1 % at most."""
    held = lambda m: math.ceil(least * m - 1e-9)
    likeness = min(held(m) / (2 * c + m - held(m)) for m in range(c // 2 + 1, c + 1))
    return math.ceil(math.log(0.001) / math.log(1 - likeness))


def _bands(window: Column, c: int, least: float) -> Column:
    """A key for each band: the band's number and size and the least hash."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands(c, least))), lambda j: F.xxhash64(F.lit(c), j, F.array_min(F.transform(window, lambda h: F.xxhash64(h, j)))))


def _listed(numbers) -> Column:
    """An array of constants, read once."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def with_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """docs with matches: license, containment and first shingle (from 1) for each template that the text holds, the best place each.

    Nothing is joined: windows, retrieval and verification are arrays of the row.
    """
    rows = [(name, text, 1 << (max(1, len(template_words(text)) - SHINGLE + 1) - 1).bit_length()) for name, text in sorted(templates.items())]
    listed = docs.sparkSession.createDataFrame(rows, "license string, t string, size int")
    sizes = sorted({r[2] for r in rows})
    grams = F.array_distinct(shingles_of(words_of(F.col("t"))))
    keyed = F.coalesce(*(F.when(F.col("size") == c, _bands(F.col("grams"), c, least)) for c in sizes))
    known = listed.withColumn("grams", grams).select("license", "grams", keyed.alias("bands")).collect()  # a row for each template
    model = F.array(*(F.struct(F.lit(r.license).alias("license"), _listed(r.grams).alias("grams"), _listed(r.bands).alias("bands")) for r in known))
    keys = _listed(sorted({b for r in known for b in r.bands}))
    anchors = F.array(*map(F.lit, hitting_set(templates, least)))
    words = docs.withColumn("_words", words_of(F.coalesce(F.col("text"), F.lit(""))))
    source = words.withColumn("_s", F.when(F.arrays_overlap("_words", anchors), shingles_of(F.col("_words")))).drop("_words")

    def windows(c: int) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size("_s"), F.lit(c)), lambda i: F.arrays_overlap(_bands(F.slice("_s", i, 2 * c), c, least), keys))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.slice("_s", F.greatest(F.lit(1), i - 2 * c), 6 * c).alias("around"), _bands(F.slice("_s", i, 2 * c), c, least).alias("bands")))

    held = source.withColumn("_w", F.when(F.col("_s").isNotNull(), F.concat(*map(windows, sizes)))).drop("_s")

    def verified(w: Column) -> Column:
        near = F.filter(model, lambda t: F.arrays_overlap(t["bands"], w["bands"]))
        share = lambda t: F.size(F.array_intersect(t["grams"], w["around"])) / F.size(t["grams"])
        return F.transform(near, lambda t: F.struct(t["license"].alias("license"), share(t).alias("containment"), (-w["at"]).alias("back")))

    found = F.filter(F.flatten(F.transform("_w", verified)), lambda m: m["containment"] >= least)
    # By license, and of each the last, which is the best.
    ranked = held.withColumn("_m", F.array_sort(F.coalesce(found, F.array().cast("array<struct<license: string, containment: double, back: int>>")))).drop("_w")
    last = F.filter("_m", lambda m, i: (i == F.size("_m") - 1) | (F.get(F.col("_m"), i + 1)["license"] != m["license"]))
    best = F.transform(last, lambda m: F.struct(m["license"].alias("license"), m["containment"].alias("containment"), (-m["back"]).cast("long").alias("first_shingle")))
    return ranked.withColumn("matches", best).drop("_m")


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment, first_shingle: a row for each template that a row of docs holds."""
    return with_matches(texts(docs), templates, least).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order, comma-joined), containment (the best; 0 without any) for every row of docs.

    Null, empty and wordless texts hold no license. Each row has what its own text holds, whatever its doc_id is. An
    empty table gives an empty one; extra columns are ignored.
    """
    out = with_matches(texts(docs), templates, least)
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"), best.alias("containment"))
