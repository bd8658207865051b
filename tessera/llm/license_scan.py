"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched.

Each template is cut into words (runs of letters and digits, lower case); hashes of its runs of words are winnowed: of each so many
neighbours the smallest stays. These fingerprints are an inverted index to templates and places, as small as the list of templates, so
it is sent to the executors. Every run of words of a document is looked up; a document without enough hits is done. For the others,
hits on neighbouring diagonals make a candidate, around which template and text are aligned within a band of BAND words: the most
words in common order count, over the template's words.

A template of SHORT words or more is found by one run of GRAM words among WINDOW neighbours: where at most a fifth of its words is left
out or replaced, GRAM + WINDOW - 1 words stay together somewhere, for SHORT or more words. A shorter notice is found by single words:
all are fingerprints, and as many as the least coverage asks for must lie near one diagonal, so words may stand between them too. Of
a short notice those words that are also in the license's name must be there, for the others fit many licenses.

Edge cases: null and empty texts have no match; repeated rows each give their own; an empty table, or none that matches, gives no
rows; a null id is carried along; further columns are ignored; a template without words matches nothing. Of matches that overlap, those
with the largest coverage are reported, and of equal coverage the longest.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, flat, texts
from tessera.llm.ngram_join import shingles

GRAM, WINDOW, BAND = 3, 2, 8
#: Templates of fewer words are looked up word by word.
SHORT = 16
COVERAGE = 0.8

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS """
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more
details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."""

#: License names, and the notices, headers and whole texts that state them (without copyright lines).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "AGPL-3.0": (_GNU.format("program", "Affero General Public License"),),
    "All-Rights-Reserved": ("All rights reserved.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": (_BSD + _BSD_END,),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        _BSD
        + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. """
        + _BSD_END,
    ),
    "BSL-1.0": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered
        by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
        Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following""",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GNU.format("program", "General Public License")),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("library", "Lesser General Public License")),
    "MIT": (
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
        deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. """
        + _AS_IS
        + """OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that
        recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law. """
        + _AS_IS
        + """BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
        removed or altered from any source distribution.""",
    ),
}

_WORD = re.compile(r"[^\W_]+")
_SCHEMA = "license string, form int, coverage double, matched int, words int, start long, end long"


def cut(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words and their spans. Characters are lowered one by one, so spans are those of the text."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest hash (the last of equal ones) among each so many neighbours."""
    out: list[int] = []
    for start in range(max(1, len(hashes) - window + 1)):
        own = range(start, min(start + window, len(hashes)))
        best = min(own, key=lambda k: (hashes[k], -k))
        if not out or out[-1] != best:
            out.append(best)
    return out


class Index:
    """An inverted index: from a fingerprint, the words of a gram, to templates and places.

    names: license and form (which of its texts) of each template. keys: hashes of the grams of each size, sorted.
    """

    def __init__(self, names: list[tuple[str, int]], words: list[list[str]], hashes: list[dict[int, list[int]]], least: float):
        self.names, self.words = names, words
        self.places: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        keys: dict[int, set[int]] = {1: set(), GRAM: set()}
        for t, own in enumerate(words):
            size = 1 if len(own) < SHORT else GRAM
            self.needed.append(max(1, math.ceil(least * len(own) - 1e-9)) if size == 1 else 1)
            for k in (range(len(own)) if size == 1 else winnow(hashes[t][size])) if own else ():
                self.places[tuple(own[k : k + size])].append((t, k))
                keys[size].add(hashes[t][size][k])
        self.keys = {size: np.array(sorted(x), dtype=np.uint64) for size, x in keys.items()}
        self.named = [set(cut(name)[0]) & set(own) if len(own) < SHORT else set() for (name, _), own in zip(names, words)]
        # Words of short templates by hash: which templates each is in.
        self.short = [t for t, own in enumerate(words) if 0 < len(own) < SHORT]
        self.member = np.array([[k in set(hashes[t][1]) for k in self.keys[1].tolist()] for t in self.short], dtype=bool).reshape(len(self.short), len(self.keys[1]))
        self.distinct = np.array([max(1, self.needed[t] - (len(words[t]) - len(set(words[t])))) for t in self.short], dtype=np.int64)

    def _hits(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are keys, and which."""
        keys = self.keys[size]
        if not len(keys) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == hashes)
        return hit, at[hit]

    def rows(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (of hashes of words) that may hold a template: with a gram of a long one, or enough words of a short one."""
        grams, ends = shingles(words, bounds, GRAM)
        hit, _ = self._hits(GRAM, grams)
        found = [np.searchsorted(ends, hit, side="right") - 1]
        hit, key = self._hits(1, shingles(words, bounds, 1)[0])
        if len(hit) and len(self.short):
            seen = np.zeros((len(bounds) - 1, len(self.keys[1])), dtype=bool)
            seen[np.searchsorted(bounds, hit, side="right") - 1, key] = True
            enough = seen.astype(np.int32) @ self.member.T.astype(np.int32) >= self.distinct
            found.append(np.flatnonzero(enough.any(axis=1)))
        return np.unique(np.concatenate(found))

    def candidates(self, words: list[str]) -> list[tuple[int, int, int]]:
        """Template, and the first and last place of the text where it may begin."""
        begins: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in range(len(words)):
            for size in (1, GRAM):
                if at + size <= len(words):
                    for t, k in self.places.get(tuple(words[at : at + size]), ()):
                        begins[t].append((at - k, k))
        out = []
        for t, found in begins.items():
            found.sort()
            diagonals = [x[0] for x in found]
            first = 0
            for k in range(1, len(found) + 1):
                # Diagonals further apart are other matches, which may follow each other closely.
                if k == len(found) or diagonals[k] - diagonals[k - 1] > BAND or diagonals[k] - diagonals[first] > len(self.words[t]) // 2:
                    near = found[bisect_left(diagonals, diagonals[first] - BAND) : bisect_right(diagonals, diagonals[k - 1] + BAND)]
                    if len({place for _, place in near}) >= self.needed[t]:
                        out.append((t, diagonals[first], diagonals[k - 1]))
                    first = k
        return out


def align(template: list[str], words: list[str], begin: int, end: int) -> tuple[int, int, int] | None:
    """The most words that match in order, within BAND of the diagonals from begin to end; with the first and last place matched.

    Of equal ones that in the narrowest band, so a copy of the text beside it is not taken for it.
    """
    best = None
    for band in (0, *(1 << k for k in range(BAND.bit_length()))):
        found = _within(template, words, begin, end, min(band, BAND))
        best = found if found and (best is None or found[0] > best[0]) else best
        if best and best[0] == len(template):
            break
    return best


def _within(template: list[str], words: list[str], begin: int, end: int, band: int) -> tuple[int, int, int] | None:
    low, width = begin - band, end - begin + 2 * band + 1
    # best[d]: (matches, minus the first place, last place) on diagonal low + d after some template words.
    best: list[tuple[int, int, int]] = [(0, 0, -1)] * width
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for d in range(width):
            at = low + d + i
            here = best[d]
            if 0 <= at < len(words) and words[at] == word:
                here = (here[0] + 1, here[1] if here[0] else -at, at)
            if d + 1 < width:
                here = max(here, best[d + 1], key=lambda x: x[:2])  # a template word left out
            if row:
                here = max(here, row[-1], key=lambda x: x[:2])  # a text word left out
            row.append(here)
        best = row
    matched, first, last = max(best, key=lambda x: x[:2])
    return (matched, -first, last) if matched else None


class Spans:
    """What a set of spans covers, as disjoint spans sorted by place, so that one looks at neighbours only."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k == len(self.starts) or end <= self.starts[k]

    def add(self, start: int, end: int) -> None:
        first, last = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if first < last:
            start, end = min(start, self.starts[first]), max(end, self.ends[last - 1])
        self.starts[first:last], self.ends[first:last] = [start], [end]


def apart(found: list[dict]) -> list[dict]:
    """Matches that no better one (by coverage, then words) overlaps, sorted by place."""
    kept: list[dict] = []
    better = Spans()
    for _, equal in groupby(sorted(found, key=lambda x: (-x["coverage"], -x["words"])), key=lambda x: (x["coverage"], x["words"])):
        # Of equal matches those of one license exclude each other; those of several licenses may share a place.
        own: dict[str, Spans] = defaultdict(Spans)
        chosen = []
        for m in equal:
            if better.free(m["start"], m["end"]) and own[m["license"]].free(m["start"], m["end"]):
                own[m["license"]].add(m["start"], m["end"])
                chosen.append(m)
        for m in chosen:
            better.add(m["start"], m["end"])
        kept += chosen
    return sorted(kept, key=lambda x: (x["start"], x["end"], x["license"]))


def matches(text: str, index: Index, least: float) -> list[dict]:
    words, spans = cut(text)
    out = []
    for t, begin, end in index.candidates(words):
        template = index.words[t]
        found = align(template, words, begin, end)
        if found and found[0] >= least * len(template) - 1e-9 and index.named[t] <= set(words[found[1] : found[2] + 1]):
            name, form = index.names[t]
            out.append({"license": name, "form": form, "coverage": found[0] / len(template), "matched": found[0], "words": len(template), "start": spans[found[1]][0], "end": spans[found[2]][1]})
    return apart(out)


def _hashed(column):
    """Hashes of the words of a text, as ``cut`` finds them."""
    split = F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(split, lambda w: F.xxhash64(w))


def build_index(spark, templates: dict[str, tuple[str, ...]], least: float) -> Index:
    """Template words are hashed by Spark as document words are; a row a template."""
    named = [(name, form, text) for name, forms in templates.items() for form, text in enumerate(forms)]
    rows = spark.createDataFrame([(t, text) for t, (_, _, text) in enumerate(named)], "t int, text string").select("t", _hashed(F.col("text")).alias("w")).collect()
    hashed = {r.t: np.array(r.w, np.int64) for r in rows}
    grams = [{size: shingles(hashed[t], np.array([0, len(hashed[t])]), size)[0].tolist() for size in (1, GRAM)} for t in range(len(named))]
    return Index([x[:2] for x in named], [cut(x[2])[0] for x in named], grams, least)


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = COVERAGE) -> DataFrame:
    """A row for each match: doc_id, license, form (which text of it), coverage, matched and words (counts), start and end (code points,
    end exclusive)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    index = build_index(spark, templates or TEMPLATES, least)
    kind = dict(docs.dtypes)["doc_id"]

    def found(batches):
        for b in batches:
            rows = index.rows(*flat(b.column("words")))
            own = [(r, m) for r, t in zip(rows, texts(b.column("text").take(pa.array(rows, pa.int64())))) for m in matches(t, index, least)]
            ids = b.column("doc_id").take(pa.array([r for r, _ in own], pa.int64()))
            types = (("license", pa.string()), ("form", pa.int32()), ("coverage", pa.float64()), ("matched", pa.int32()), ("words", pa.int32()), ("start", pa.int64()), ("end", pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[c] for _, m in own], t) for c, t in types)], ["doc_id", *(c for c, _ in types)])

    rows = docs.select("doc_id", "text", _hashed(F.col("text")).alias("words"))
    return rows.mapInArrow(found, f"doc_id {kind}, {_SCHEMA}")
