"""Licence scans by a positional rare-token index.

Templates (base phrases and whole licence notices) are cut into words; postings
hold, for each word, the templates and places where it stands.  A word's IDF
comes from all documents.  A template's own words of the highest IDF are looked
up in a file; each hit is a (template, relative position), and these are
verified: a base phrase word by word, a notice by its mandatory
key phrases and by the share of its words that stand where they should.

A base phrase's rarest word is looked up at every place it has, and of a notice
so many of its rarest words that none can lack them all and still have its
share, so no place is missed, however long the file.

Null text counts as empty: no words, no labels, score 0, null places.  Repeated
rows each get their own answer; ties between words of equal IDF go to the
smaller word; an empty table gives no rows; a very long text is scanned whole, in
memory in proportion to itself; of other columns nothing is read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import _common as C

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices, their labels and the key phrases that have to stand in a file.
NOTICES = (
    ("released under the mit license", "mit", ("mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ("permission is hereby granted",)),
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license", "version 2 0")),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ("general public license", "version 3")),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", ("general public license", "version 2")),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("cc by nc 4 0",)),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ("cc by sa 4 0",)),
    ("licensed under cc by 4 0", "cc-by-4.0", ("cc by 4 0",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("redistribution and use in source and binary forms",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ("mozilla public license",)),
)
# Whole texts of common licences and of their notices for files.
TEXTS = (
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit", ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-2-clause", ("redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"),
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc", ("for any purpose with or without fee is hereby granted",),
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        "zlib", ("must not be misrepresented", "altered source versions"),
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache-2.0", ("apache license version 2 0",),
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "gpl-3.0-or-later", ("general public license", "either version 3 of the license"),
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""",
        "mpl-2.0", ("mozilla public license v 2 0",),
    ),
)
#: The share of a notice's words, by IDF, that have to stand where they should.
LEAST = 0.8
#: ASCII letters and digits and all of UTF-8 beyond ASCII make words; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    base: bool
    keys: tuple[tuple[bytes, ...], ...]


def templates() -> list[Template]:
    cut = lambda s: tuple(s.encode().split())
    texts = [Template(tuple(words_of(p.encode())), x, False, tuple(map(cut, k))) for p, x, k in TEXTS]
    return [Template(cut(p), x, True, (cut(p),)) for p, x in BASE] + [Template(cut(p), x, False, tuple(map(cut, k))) for p, x, k in NOTICES] + texts


@dataclass(frozen=True)
class Index:
    all: tuple[Template, ...]
    idf: dict[bytes, float]
    whole: tuple[float, ...]  # the IDF of a template's words
    postings: dict[bytes, tuple[tuple[int, int], ...]]  # of notices, at their rarest words
    anchors: dict[bytes, tuple[tuple[int, int], ...]]  # of base phrases, at their rarest word

    @cached_property
    def looked_up(self) -> frozenset[bytes]:
        return frozenset(self.postings.keys() | self.anchors.keys())


def build_index(frequency: dict[bytes, int], n_docs: int, found: list[Template] | None = None) -> Index:
    """frequency: documents that hold a licence word."""
    found = found or templates()
    vocabulary = {w for t in found for w in t.words}
    idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1 for w in vocabulary}
    whole = [sum(idf[w] for w in t.words) for t in found]
    postings: dict[bytes, list] = {}
    anchors: dict[bytes, list] = {}
    for i, t in enumerate(found):
        if t.base:
            at = min(range(len(t.words)), key=lambda j: (-idf[t.words[j]], t.words[j]))
            anchors.setdefault(t.words[at], []).append((i, at))
        else:
            # what stands without any of these words lacks more than a notice may lack
            looked_up = 0.0
            for at in sorted(range(len(t.words)), key=lambda j: (-idf[t.words[j]], t.words[j], j)):
                postings.setdefault(t.words[at], []).append((i, at))
                looked_up += idf[t.words[at]]
                if looked_up > (1 - LEAST + 1e-9) * whole[i]:
                    break
    freeze = lambda d: {k: tuple(v) for k, v in d.items()}
    return Index(tuple(found), idf, tuple(whole), freeze(postings), freeze(anchors))


def _stands(words: list[bytes], at: int, phrase: tuple[bytes, ...]) -> bool:
    return at >= 0 and tuple(words[at : at + len(phrase)]) == phrase


def scan(words: list[bytes], index: Index) -> dict:
    """Base places (start, template), labels and score of one file's words."""
    base: list[tuple[int, int]] = []
    labels: set[str] = set()
    best = 0.0
    looked_up = index.looked_up
    if not looked_up.isdisjoint(words):
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in looked_up:
                places.setdefault(w, []).append(i)
        for w, where in index.anchors.items():
            for i in places.get(w, ()):
                for t, at in where:
                    if _stands(words, i - at, index.all[t].words):
                        base.append((i - at, t))
        candidates = {(t, i - at) for w, where in index.postings.items() for i in places.get(w, ()) for t, at in where}
        for t, start in candidates:
            found = index.all[t]
            matched = sum(index.idf[w] for j, w in enumerate(found.words) if 0 <= start + j < len(words) and words[start + j] == w)
            if matched < LEAST * index.whole[t]:
                continue
            near = range(max(0, start - 4), min(len(words), start + len(found.words) + 4))
            if all(any(_stands(words, i, k) for i in near) for k in found.keys):
                labels.add(found.label)
                best = max(best, min(1.0, matched / index.whole[t]))
    own = {index.all[t].label for _, t in base}
    starts = [i for i, _ in base]
    return {"n_base": len(base), "first": min(starts, default=None), "last": max(starts, default=None), "base_labels": sorted(own), "labels": sorted(labels | own), "score": max(best, 1.0 if own else 0.0), "places": sorted(base)}


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of a fixed vocabulary, and all documents."""

    def run(batches):
        seen, n = Counter(), 0
        for b in batches:
            for text in C.column_bytes(b, "text"):
                n += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": [*seen, None], "n": [*seen.values(), n]}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row for each licence word
    got = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    return {w: n for w, n in got.items() if w is not None}, got.get(None, 0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  places: start:label of every base place."""
    frequency, n = word_frequencies(docs, {w for t in templates() for w in t.words})
    told = docs.sparkSession.sparkContext.broadcast(build_index(frequency, n))  # the templates' words

    def run(batches):
        index = told.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), C.column_bytes(b, "text")):
                words = words_of(text)
                x = scan(words, index)
                rows.append((doc_id, len(words), x["n_base"], x["first"], x["last"], ",".join(x["base_labels"]), ",".join(x["labels"]), x["score"], ",".join(f"{i}:{index.all[t].label}" for i, t in x["places"])))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(C.read(spark, sf_dir, "documents")).drop("places")
