"""License scans. DataFrame and SQL functions only: one narrow pass, no shuffle, no Python.

Texts become five-word shingles (lower-cased runs of a-z and 0-9). Overlapping windows of shingles are MinHashed, and a
band whose value equals a template's own band value makes that template a candidate for the text; exact shingle
containment (0.8 of the template's shingles in the text) then decides. A template of one to four words is one shingle of
its own length, looked up exactly as a run of words.

Collision probability: windows are no longer than the templates of their class (one shingle for templates under eight
shingles; eight shingles, a new one every four, for the others), so in each band the template's minimum is also the
minimum of some window of a copied passage whenever the passage holds that shingle and no foreign shingle of the window
undercuts it. A band is one value and there are BANDS of them: an exact copy never escapes for the short class, and a
passage copied in one piece that holds 0.8 of the template does with 0.2**8 < 3e-6; edits inside a passage add foreign
shingles to its windows (the tests measure what is found then).

Defined cases: a null or empty text matches nothing, one with fewer than five words only short templates; texts of any
length are read whole; a template without words is ignored; repeated rows give repeated matches; nulls in ids are carried
through; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices as their licenses word them.
TEMPLATES = {
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT full text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause full text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

# What the query looks for: the templates, and notices of fewer words than a shingle.
NOTICES = TEMPLATES | {"All rights reserved": "All rights reserved."}

BANDS = 8
TABLE_BYTES = 64 << 20
WINDOW, STEP, SMALL = 8, 4, 8

WORDS = "array_remove(split(lower(coalesce(text, '')), '[^a-z0-9]+'), '')"
SHINGLES = "if(size(w) >= 5, transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])), cast(array() AS array<bigint>))"


def _hashed(df: DataFrame, *keep: str, short: tuple[str, ...] = ()) -> DataFrame:
    """Shingle hashes h0 and three rehashes; the minimum and the maximum of each make the eight bands. ``runs``: those of
    the ``short`` runs of words (a-z, 0-9 and spaces only) that the text holds.

    ``explode`` of a one-element array keeps the optimizer from copying an expression into each of its uses, and the
    outer ``transform`` binds the words once: both are what makes this linear in the text.
    """
    runs = "cast(array() AS array<string>)"
    if short:
        runs = f"transform(array(concat(' ', array_join(w, ' '), ' ')), j -> filter(array({', '.join(f"'{r}'" for r in short)}), r -> contains(j, concat(' ', r, ' '))))[0]"
    d = df.select(*keep, F.explode(F.array(F.expr(f"transform(array({WORDS}), w -> named_struct('h0', {SHINGLES}, 'runs', {runs}))[0]"))).alias("x")).select(*keep, "x.h0", "x.runs")
    more = ", ".join(f"'h{i}', transform(h0, x -> xxhash64(x, {i}))" for i in range(1, BANDS // 2))
    return d.select(*keep, "h0", "runs", F.expr(f"inline(array(named_struct({more})))"))


def templates(spark: SparkSession, texts: dict[str, str]) -> list[tuple[str, list[int], list[int], bool]]:
    """(name, shingles, band values, small) of each template; as many rows as there are templates."""
    d = _hashed(spark.createDataFrame(list(texts.items()), "name string, text string"), "name")
    bands = F.array(*[f(f"h{i}") for i in range(BANDS // 2) for f in (F.array_min, F.array_max)])
    return [(r[0], r[1], r[2], len(r[1]) < SMALL) for r in d.select("name", F.array_distinct("h0"), bands).where(F.size("h0") > 0).collect()]


def short_templates(spark: SparkSession, texts: dict[str, str]) -> list[tuple[str, str]]:
    """(name, run of words) of each template with fewer words than a shingle."""
    d = spark.createDataFrame(list(texts.items()), "name string, text string").withColumn("w", F.expr(WORDS))
    return [tuple(r) for r in d.where(F.size("w").between(1, 4)).select("name", F.array_join("w", " ")).collect()]


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per text and template found in it: doc_id, license, shared, template_shingles, containment."""
    texts = TEMPLATES if texts is None else texts
    known, short = templates(docs.sparkSession, texts), short_templates(docs.sparkSession, texts)
    out = "doc_id bigint, license string, shared int, template_shingles int, containment double"
    if not known and not short:
        return docs.sparkSession.createDataFrame([], out)
    lits = lambda v: F.array(*[F.lit(x).cast("long") for x in v]) if v else F.expr("cast(array() AS array<bigint>)")
    d = _hashed(docs, "doc_id", short=tuple(sorted({run for _, run in short})))
    found = []
    for b in range(BANDS):
        h, pick = f"h{b // 2}", "array_min" if b % 2 == 0 else "array_max"
        small = F.array_intersect(F.col(h), lits(sorted({t[2][b] for t in known if t[3]})))
        windows = F.expr(f"transform(sequence(0, greatest(0, (size({h}) - {STEP + 1}) div {STEP})), i -> {pick}(slice({h}, i * {STEP} + 1, {WINDOW})))")
        found += [small, F.array_intersect(windows, lits(sorted({t[2][b] for t in known if not t[3]})))]
    d = d.select("doc_id", "h0", "runs", F.explode(F.array(F.concat(*found))).alias("hits"))
    row = lambda name, bands, run: F.struct(F.lit(name).alias("license"), lits(bands).alias("bands"), F.lit(run).cast("string").alias("run"))
    table = F.array(*[row(t[0], t[2], None) for t in known], *[row(name, [], run) for name, run in short])
    found_in = lambda t: F.arrays_overlap(t["bands"], F.col("hits")) | F.array_contains(F.col("runs"), t["run"])
    d = d.where((F.size("hits") > 0) | (F.size("runs") > 0)).select("doc_id", "h0", F.explode(F.filter(table, found_in)).alias("t"))
    # only the band values are part of the plan; the shingles of all templates are a small table, sent once to each executor
    if (size := sum(8 * len(t[1]) for t in known)) > TABLE_BYTES:
        raise ValueError(f"templates of {size} bytes of shingles: scan for them in several calls")
    wanted = docs.sparkSession.createDataFrame([(t[0], t[1]) for t in known], "license string, sh array<bigint>")
    d = d.select("doc_id", "h0", F.col("t.license").alias("license"), F.col("t.run").alias("run")).join(F.broadcast(wanted), "license", "left")
    count = lambda n: F.when(F.col("run").isNotNull(), 1).otherwise(n)
    d = d.select("doc_id", "license", count(F.size(F.array_intersect("h0", "sh"))).alias("shared"), count(F.size("sh")).alias("template_shingles"))
    return d.where("5 * shared >= 4 * template_shingles").withColumn("containment", F.col("shared") / F.col("template_shingles"))
