"""License scans by MinHash bands over overlapping windows, in DataFrame operations alone.

Texts and templates become lower-cased words and five-word shingles. Every window of consecutive shingles is reduced to band values, the least
of its shingles' hashes in each band's order, which are looked up among those of the templates' windows; a hit fixes how template and text
align. Then the shingles of the text around that place are compared with the template's, word for word, and a template of which at
least ``threshold`` is contained is a match.

Bands. A band's order is that of the hashes after XOR with the band's constant, so one hash gives all permutations, and
two windows agree in a band with a probability that is their Jaccard similarity. ``WINDOWS`` gives the window by the template's length. A word that is
changed, added or lost takes four shingles in a row or more, so a fifth of n shingles is lost in 0.05 n runs at most, and some run of what is left has
0.8 n / (0.05 n + 1) shingles: at 24 shingles and more that is a whole window of 10, at 6 to 23 a whole window of 3, and equal windows
collide in every band. Templates of fewer shingles have windows of one. Where losses are scattered otherwise, the bands of the best windows decide: with
two a window of J = 2/3 is found with probability 1 - (1/3)^2 = 0.89, and a template has many.

Scale: a text without any shingle of the templates (most of them) needs no windows. Documents are read twice and not shuffled; only hits and one narrow row per document are. Words are hashed once; hashes of shingles and least
hashes of windows come by doubling. The template table is a parameter and is broadcast
when its measured size allows; so are the documents with hits, by count.

Defined results: null texts have no words; templates shorter than five words are refused; of places with equal containment the first is told; repeated
rows each get their row; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, alnum_words, cut, lesser, let, mixed, spread

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of a template from which on its windows have so many shingles, and their bands.
WINDOWS = ((24, 10, 2), (6, 3, 1), (1, 1, 1))
BROADCAST_ROWS = 200_000
#: Shingles of all templates up to which a text's are first looked up among them; with more, every text goes through its windows.
KNOWN = 20_000

# Wording of common license notices.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_FREE = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = (
    ("AGPL-3.0", _FREE.format("program", "Affero ", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", _BSD_END),
    ("BSD-2-Clause", f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _FREE.format("program", "", "3")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", _FREE.format("library", "Lesser ", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MIT", f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
#: Constants whose leading bits differ, so that the bands order hashes differently.
_FLIPS = [((i * 0x9E3779B97F4A7C15) ^ (i << 61)) & (1 << 64) - 1 for i in range(16)]
_HITS = "array<struct<band:int,hash:bigint,pos:int>>"
#: Places take the low bits of a mark.
_POS = (1 << 31) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _grams(words: Column) -> Column:
    """The shingles of a text that has one, as text."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def _shingles(words: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` over the hashes of the shingles."""
    return spread(F.transform(words, lambda w: F.xxhash64(w)), SHINGLE, mixed, then)


def _marks(words: Column, windows: list[tuple[int, int, int]], known: list[int] | None = None) -> Column:
    """The least shingles of all windows of a text, (band, hash, 1-based place), for windows (number of the first band, shingles, bands). None if
    the text has no shingle of the ``known`` ones, those of all templates: no window can collide then."""

    def band(h: Column, nth: int, size: int) -> Column:
        placed = F.transform(h, lambda x, i: x.bitwiseXOR(F.lit(_signed(_FLIPS[nth]))).bitwiseAND(F.lit(~_POS)).bitwiseOR((i + 1).cast("long")))
        mark = lambda v: F.struct(F.lit(nth).alias("band"), F.shiftright(v, 31).alias("hash"), v.bitwiseAND(F.lit(_POS)).cast("int").alias("pos"))
        made = spread(placed, size, lesser, lambda m: F.transform(F.array_distinct(m) if size > 1 else m, mark))
        return F.when(F.size(h) >= size, made.cast(_HITS)).otherwise(F.array().cast(_HITS))

    def every(h: Column) -> Column:
        made = F.concat(*(band(h, first + b, size) for first, size, bands in windows for b in range(bands)))
        return made if known is None else F.when(F.exists(h, lambda x: x.isin(known)), made).otherwise(F.array().cast(_HITS))

    return F.when(F.size(words) >= SHINGLE, _shingles(words, every)).otherwise(F.array().cast(_HITS))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """tid, license, words of each template."""
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "tid int, license string, text string")
    table = table.select("tid", "license", alnum_words(F.col("text")).alias("words"))
    if not table.where(F.size("words") < SHINGLE).isEmpty():
        raise ValueError("templates must have five words or more")
    return table


def scan(docs: DataFrame, templates: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc, n_words, matches (array of structs license, tid, containment, start), the best place of each template."""
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    base = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    sizes = [r[0] for r in templates.select(F.greatest(F.lit(1), *(F.when(F.size("words") - SHINGLE + 1 >= least, size) for least, size, _ in WINDOWS)).alias("w")).distinct().collect()]  # at most one of each
    bands = [sum(b for _, _, b in WINDOWS[:i]) for i in range(len(WINDOWS))]
    used = [(first, least, size, n) for first, (least, size, n) in zip(bands, WINDOWS) if size in sizes]
    marks = F.array().cast(_HITS)
    for first, least, size, n in reversed(used):
        marks = F.when(F.size("words") - SHINGLE + 1 >= least, _marks(F.col("words"), [(first, size, n)])).otherwise(marks)
    index = cut(templates.select("tid", F.explode(marks).alias("p")).select("tid", "p.band", "p.hash", F.col("p.pos").alias("at")))
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    held = templates.select(F.explode(_shingles(F.col("words"), lambda h: h)).alias("h")).distinct().limit(KNOWN + 1).collect()
    known = sorted(r.h for r in held) if len(held) <= KNOWN else None
    probes = base.where("text IS NOT NULL").select("doc", "text_hash", F.explode(let(alnum_words(F.col("text")), lambda w: _marks(w, [(first, size, n) for first, _, size, n in used], known) if used else F.array().cast(_HITS))).alias("p"))
    hits = probes.select("doc", "text_hash", "p.band", "p.hash", "p.pos").join(index, ["band", "hash"])
    found = cut(hits.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("tid", (F.col("pos") - F.col("at")).alias("shift"))).alias("places")))

    known = templates.select("tid", "license", let(F.col("words"), _grams).alias("shingles"))
    known = known.withColumn("distinct", F.array_distinct("shingles"))
    few = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    texts = base.join(few.withColumnRenamed("doc", "doc_").withColumnRenamed("text_hash", "hash_"), F.col("doc").eqNullSafe(F.col("doc_")) & F.col("text_hash").eqNullSafe(F.col("hash_"))).dropDuplicates(["doc", "text_hash"])
    around = texts.select("doc", "text_hash", let(alnum_words(F.col("text")), _grams).alias("s"), F.explode("places").alias("p"))
    slack = F.greatest(F.lit(2), F.floor((F.size("shingles") + SHINGLE - 1) / 4).cast("int"))
    begin = F.greatest(F.lit(1), F.col("p.shift") + 1 - slack)
    region = F.slice("s", begin, F.greatest(F.lit(0), F.col("p.shift") + F.size("shingles") + slack - begin + 1))
    exact = around.join(F.broadcast(known) if templates.count() <= BROADCAST_ROWS else known, F.col("p.tid") == F.col("tid")).select("doc", "text_hash", "license", "tid", F.greatest(F.lit(1), F.col("p.shift") + 1).alias("start"), (F.size(F.array_intersect("distinct", region)) / F.size("distinct")).alias("containment"))
    best = exact.where(F.col("containment") >= threshold - 1e-12).groupBy("doc", "text_hash", "license", "tid").agg(F.max(F.struct("containment", (-F.col("start")).alias("start"))).alias("x"))
    best = best.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(F.struct("license", "tid", F.col("x.containment").alias("containment"), (-F.col("x.start")).alias("start")))).alias("matches"))
    best = cut(best)
    best = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    rows = base.select("doc", "text_hash", F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = rows.join(best.withColumnRenamed("doc", "doc_").withColumnRenamed("text_hash", "hash_"), F.col("doc").eqNullSafe(F.col("doc_")) & F.col("text_hash").eqNullSafe(F.col("hash_")), "left")
    return joined.select("doc", "n_words", F.coalesce("matches", F.array().cast(best.schema["matches"].dataType)).alias("matches"))
