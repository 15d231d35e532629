"""License scans in DataFrame functions only.

A document's words are its runs of a-z and 0-9 after lower-casing.  Templates of m words are looked for in
windows of m + s words, s = max(1, m // 8) apart, so that every place of a template lies within a window.  Each
window's 5-word shingles give `BANDS` minima, each under a hash of its own (xxhash64 of shingle and band); a shared
minimum (bands of one row) retrieves a template, and the share of its shingles in the window, at least 0.8,
verifies it.  A window that holds 80 % of a template's shingles has similarity of at least `least_similarity`
to it, 0.5 or more for the templates here, so it shares no band with probability below (1 - 0.5)^24 < 6e-8.

Only windows with enough trigger words are opened.  This loses nothing: a trigger word stands in five shingles at
most, so a window with too few of them lacks more than a fifth of the template's shingles (`needed`), and in
every template more than a fifth of the shingles hold a trigger word (`uncovered` proves it).

Defined cases: null or empty text, fewer than five words: no match; rows that share a doc_id count as one
document; a null doc_id is reported as null; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public license texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", MIT),
    ("ISC", ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License v3."),
    ("GPL-3.0", GPL),
    ("GPL", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Zlib", ZLIB),
    ("Unlicense", UNLICENSE),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
TRIGGERS = ["licen", "permi", "redistribut", "software", "copyright", "warrant", "public"]
WIDTH, SHARE, BANDS = 5, 0.8, 24
#: Bytes of template bands that are broadcast at most.
MAX_BROADCAST = 16 << 20


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def geometry(m: int) -> tuple[int, int]:
    """Window length and step for a template of m words."""
    s = max(1, m // 8)
    return m + s, s


def _marked(text: str) -> tuple[int, int]:
    """Distinct shingles of a template, and how many of them hold a trigger word."""
    w = words_of(text)
    shingles = {tuple(w[a : a + WIDTH]) for a in range(len(w) - WIDTH + 1)}
    return len(shingles), sum(any(t in x for x in s for t in TRIGGERS) for s in shingles)


def uncovered(templates=TEMPLATES) -> list[str]:
    """Templates whose shingles with a trigger are a fifth or less (must be none)."""
    return [text for _, text in templates if (n := _marked(text))[1] <= (1 - SHARE) * n[0] + 1e-9]


def needed(m: int, templates=TEMPLATES) -> int:
    """Trigger words without which no window holds 80 % of a template of m words."""
    few = [math.ceil((hit - (1 - SHARE) * n) / WIDTH - 1e-9) for _, text in templates if len(words_of(text)) == m for n, hit in [_marked(text)]]
    return max(1, min(few))


def least_similarity(text: str) -> float:
    """Jaccard similarity that any window with 80 % of the template's shingles has to it."""
    m = len(words_of(text))
    n, window = _marked(text)[0], sum(geometry(m)) - geometry(m)[1] - WIDTH + 1
    held = math.ceil(SHARE * n - 1e-9)
    return held / (max(window, held) + n - held)


def _shingles(words: Column) -> Column:
    n = F.size(words) - WIDTH + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, F.lit(WIDTH)))))).otherwise(F.array().cast("array<long>"))


def _minima(shingles: Column) -> Column:
    def under(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*[under(k) for k in range(BANDS)])


def _windows(words: Column, hits: Column, m: int, least: int) -> Column:
    """Windows for templates of m words with `least` triggers or more: array of (m, start, words)."""
    w, s = geometry(m)
    last = F.greatest(F.size(words) - w, F.lit(0))
    low = lambda t: F.least(F.greatest(F.ceil((t - w + 1) / s).cast("int"), F.lit(0)) * s, last)
    high = lambda t: F.least(F.floor(t / s).cast("int") * s, last)
    near = lambda t: F.concat(F.filter(F.sequence(F.floor(low(t) / s).cast("int") * s, F.greatest(high(t), F.floor(low(t) / s).cast("int") * s), F.lit(s)), lambda a: (a <= last) & (a <= t) & (a + w > t)), F.when(last + w > t, F.array(last)).otherwise(F.array().cast("array<int>")))
    starts = F.array_distinct(F.flatten(F.transform(hits, near)))
    if least > 1:
        starts = F.filter(starts, lambda a: F.size(F.filter(hits, lambda t: (t >= a) & (t < a + w))) >= least)
    return F.transform(starts, lambda a: F.struct(F.lit(m).alias("m"), a.alias("start"), F.slice(words, a + 1, F.lit(w)).alias("words")))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document and license found: doc_id, license, containment (largest), n_windows, first_word."""
    if bad := uncovered(templates):
        raise ValueError(f"templates without enough trigger words: {bad}")
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, name, words_of(t)) for k, (name, t) in enumerate(templates)], "t int, license string, w array<string>")
    # a fixed table of len(templates) rows
    known = known.select("t", "license", F.size("w").alias("m"), _shingles(F.col("w")).alias("ts"))
    keys = known.select("t", "license", "m", "ts", F.posexplode(_minima(F.col("ts"))).alias("band", "low"))

    low = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("low"))
    some = F.lit(False)
    for t in TRIGGERS:
        some = some | F.col("low").contains(t)
    rows = low.where(some).select("doc_id", F.regexp_extract_all("low", F.lit("[a-z0-9]+"), 0).alias("w"))
    is_hit = lambda x: x.rlike("|".join(TRIGGERS))
    rows = rows.withColumn("hits", F.filter(F.transform("w", lambda x, i: F.when(is_hit(x), i)), lambda i: i.isNotNull()))
    sizes = sorted({len(words_of(t)) for _, t in templates})
    win = rows.select("doc_id", F.explode(F.concat(*[_windows(F.col("w"), F.col("hits"), m, needed(m, templates)) for m in sizes])).alias("x")).select("doc_id", "x.m", "x.start", _shingles(F.col("x.words")).alias("ws"))
    cand = win.where(F.size("ws") > 0).select("doc_id", "m", "start", "ws", F.posexplode(_minima(F.col("ws"))).alias("band", "low"))
    # 8 bytes a shingle in each of a template's bands: broadcast below a bound, else joined by exchange
    size = 8 * BANDS * sum(len(words_of(t)) for _, t in templates)
    cand = cand.join(F.broadcast(keys) if size <= MAX_BROADCAST else keys, ["m", "band", "low"])
    share = F.size(F.array_intersect("ws", "ts")) / F.size("ts")
    hits = cand.withColumn("share", share).where(F.col("share") >= SHARE)
    hits = hits.groupBy("doc_id", "license", "m", "start").agg(F.max("share").alias("share"))
    return hits.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("start").cast("int").alias("first_word"))


def sql(templates=TEMPLATES) -> str:
    """The same over all windows of the grid, without retrieval, in DuckDB."""
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(w) for w in words_of(t))}], {geometry(len(words_of(t)))[0]}, {geometry(len(words_of(t)))[1]})" for k, (name, t) in enumerate(templates))
    return f"""
WITH k(t, license, w, width, step) AS (VALUES {rows}),
ks AS (SELECT DISTINCT t, license, width, step, list_slice(w, i, i + 4) AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM k)),
kn AS (SELECT t, count(*) AS n FROM ks GROUP BY t),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n_words, i - 1 AS p, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, n_words, p, ks.t, license, width, step, s.g FROM s JOIN ks ON s.g = ks.g),
a AS (SELECT DISTINCT *, unnest(list_append([x * step for x in range(0, n_words // step + 1) if x * step <= greatest(n_words - width, 0)], greatest(n_words - width, 0))) AS start FROM h),
c AS (SELECT doc_id, t, license, width, start, count(DISTINCT g) AS hit FROM a WHERE p >= start AND p + 5 <= start + width GROUP BY ALL),
f AS (SELECT doc_id, license, width, start, max(hit / n) AS share FROM c JOIN kn USING (t) WHERE hit / n >= {SHARE} GROUP BY ALL)
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, min(start)::INTEGER AS first_word FROM f GROUP BY ALL
"""
