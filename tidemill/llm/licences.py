"""License scans by MinHash over overlapping text windows (operator 4): DataFrame functions only.

A template of n words is looked for in windows of n + stride words that begin every stride words, stride being a quarter of
n: an occurrence lies whole in one of them. A window that holds it has a Jaccard similarity of at least about 1/3 with the
template; with BANDS bands of one MinHash each, such a window is retrieved with 1 - (2/3)^24 > 0.9999. What is retrieved
counts only if it holds at least CONTAINED of the template's five-word shingles.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, small, stored
from .decontaminate import words

SHINGLE, BANDS, CONTAINED = 5, 24, 0.8
#: Public licence notices, opening sentences, and the whole texts of short licences. More are given as a parameter.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
]


def shingled(of: Column, size: Column) -> Column:
    """Distinct hashes of shingles of size words; of fewer words: the whole sequence."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(of) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(of, i, size), " "))))


def shingle_size(n: Column) -> Column:
    """Five words; a template of fewer is one shingle."""
    return F.least(n, F.lit(SHINGLE))


def bands(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))).alias("least")))


def tokens(text: str) -> list[str]:
    """A template's words, as words() finds them."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def marks(text: str, contained: float = CONTAINED) -> set[str]:
    """Words, the longest first, that stand in so many of the template's shingles that what holds a share of contained has one."""
    w = tokens(text)
    parts = [set(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]
    found: set[str] = set()
    for word, _ in sorted(Counter(w).items(), key=lambda x: (-len(x[0]), x[0])):
        if sum(bool(found & p) for p in parts) > (1 - contained) * len(parts) + 1e-9:
            return found
        found.add(word)
    return found


def scanned(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment, first_word, n_windows: one row for each license found in a doc_id's texts.

    containment is the best window's share of the template's shingles, first_word the place (in words, from 0) where the
    first window that holds it begins, n_windows how many do. Null, empty and wordless texts hold nothing; repeated rows
    count as one document of that doc_id, rows without a doc_id as one of none. Windows cover whole texts; windows and
    texts without one of a template's marks can't hold enough of it and are passed over.
    """
    templates = [(name, text) for name, text in templates if tokens(text)]
    if not templates:
        return documents.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    spark: SparkSession = documents.sparkSession
    known = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string").withColumn("words", words(F.col("text")))
    known = known.select("template", "license", F.size("words").alias("n"), shingled(F.col("words"), shingle_size(F.size("words"))).alias("wanted"))
    by_size: dict[int, set[str]] = {}
    for _, text in templates:
        by_size.setdefault(len(tokens(text)), set()).update(marks(text, contained))
    kinds = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(-(-n // 4)).alias("stride"), F.array(*map(F.lit, sorted(m))).alias("marks")) for n, m in sorted(by_size.items())))
    any_mark = "|".join(sorted(set().union(*by_size.values())))
    held = documents.select("doc_id", lower_ascii(F.col("text")).alias("text")).where(F.col("text").rlike(f"(?<![0-9a-z])(?:{any_mark})(?![0-9a-z])"))
    held = held.select("doc_id", words(F.col("text")).alias("words"))
    held = held.select("doc_id", "words", F.explode(F.filter(kinds, lambda k: F.arrays_overlap("words", k["marks"]))).alias("kind")).select("doc_id", "words", "kind.*")
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.col("stride"))
    cut = held.select("doc_id", "n", "marks", F.explode(F.transform(starts, lambda s: F.struct(s.alias("first_word"), F.slice("words", s + 1, F.col("n") + F.col("stride")).alias("window")))).alias("at"))
    cut = cut.where(F.arrays_overlap("at.window", "marks")).select("doc_id", "n", "at.first_word", shingled(F.col("at.window"), shingle_size(F.col("n"))).alias("shingles"))
    cut = stored(cut, "windows")
    hashed = cut.select("doc_id", "n", "first_word", "shingles", F.inline(bands(F.col("shingles"))))
    sought = known.select("template", "license", "n", "wanted", F.inline(bands(F.col("wanted"))))
    met = hashed.join(small(stored(sought, "templates")), ["n", "band", "least"])
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    met = met.select("doc_id", "first_word", "template", "license", share.alias("containment")).where(F.col("containment") >= contained).distinct()
    return met.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.count_distinct("first_word", "template").alias("n_windows"))
