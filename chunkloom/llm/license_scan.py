"""Operator 3: licence scans by Dice coefficient over word bigrams.

Each line, each paragraph (lines between blank lines), the whole of a text, and each of its windows is a
segment. A window has as many words as the template it is compared with (fewer at the text's end) and begins with a
bigram of it, so a licence in several paragraphs, after code or within a line of prose is
one segment wherever it stands. A segment's words (lower case, runs of letters and digits) give a set A of
bigrams, a template's words a set B, and the segment carries the licence if 2|A & B| / (|A| + |B|) >= ``LEAST``.

Two exact bounds leave few comparisons. Size: |A| must lie between |B| t / (2 - t) and
|B| (2 - t) / t. Overlap: at least t / (2 - t) of B must be in A, so A holds one of any
|B| - ceil(|B| t / (2 - t)) + 1 bigrams of B; those whose words are least common are looked
up among all bigrams of the texts at once, and only segments with one of them, of texts that hold
enough of B at all, are compared. The windows of a text are counted all at once, by running sums.

Templates ship with the operator: notices and short licences below, and in the folder ``licences`` the
full texts of Apache-2.0, GPL-2.0 and -3.0, LGPL-2.1 and -3.0, MPL-2.0 and CC0-1.0. There is no full
text of AGPL-3.0 and of the Creative Commons licences besides CC0; they are known by their notices. Everything happens in one scan,
without a shuffle.

Defined results: null, empty and one-word texts carry no licence; a licence that repeats in a
document has one row, with its best coefficient; very long texts are read whole; repeated rows give repeated results; ties
between templates of a licence are one row; an empty table gives an empty result; further
columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST = 0.8
_SCHEMA = "doc_id bigint, license string, dice double"
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS 'AS IS' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (licence, text); a licence may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. " + _WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED 'AS IS' AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
]
TEMPLATES += [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
_COMMON = frozenset("a an and any are as at be by can for from if in is it may no not of on or shall that the this to under with without you".split())


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each pair of neighbouring words."""
    return C.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def least_overlap(b: int, least: float = LEAST) -> int:
    return math.ceil(b * least / (2 - least) - 1e-9)


@lru_cache(4)
def _prepared(least: float) -> tuple[list[tuple[str, np.ndarray, int]], np.ndarray, dict[int, list[int]]]:
    """(licence, bigrams and number of bigrams with repeats of each template, sorted bigrams to look up, templates of each of these)."""
    sets, lookup = [], {}
    for k, (name, text) in enumerate(TEMPLATES):
        words = re.findall(r"[a-z0-9]+", text.lower())
        pairs = _pairs(C.word_hashes(pa.array([text]))[1])
        rare: dict[int, int] = {}
        for i, p in enumerate(pairs.tolist()):
            r = sum(w in _COMMON for w in words[i : i + 2]) * 100 - len(words[i]) - len(words[i + 1])
            rare[p] = min(r, rare.get(p, r))
        b = np.unique(pairs)
        for p in sorted(rare, key=lambda p: (rare[p], p))[: len(b) - least_overlap(len(b), least) + 1]:
            lookup.setdefault(p, []).append(k)
        sets.append((name, b, len(pairs)))
    return sets, np.array(sorted(lookup), np.uint64), lookup


def licences(text: pa.Array, least: float = LEAST) -> list[tuple[int, str, float]]:
    """(row, licence, best coefficient) of each text."""
    sets, sought, lookup = _prepared(least)
    rows, hashes, first, raw, off = C.word_hashes(text, places=True)
    if len(rows) < 2:
        return []
    pairs = _pairs(hashes)
    at = np.searchsorted(sought, pairs)
    at[at == len(sought)] = 0
    hits = np.flatnonzero((sought[at] == pairs) & (rows[1:] == rows[:-1]))
    found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k in hits.tolist():
        for t in lookup[int(pairs[k])]:
            found[int(rows[k])][t].append(k)
    out = []
    for row, of in found.items():
        best: dict[str, float] = {}
        i, j = np.searchsorted(rows, [row, row + 1]).tolist()
        mine = pairs[i : j - 1]
        segments = _Segments(raw[int(off[row]) : int(off[row + 1])].tobytes(), first[i:j] - int(off[row]))
        before = _previous(mine)
        sizes: dict[tuple[int, int], int] = {}
        for t, places in of.items():
            name, b_, n = sets[t]
            low, high = least_overlap(len(b_), least), math.floor(len(b_) * (2 - least) / least + 1e-9)
            where = np.searchsorted(b_, mine)
            where[where == len(b_)] = 0
            shared = b_[where] == mine
            if np.count_nonzero(shared & (before < 0)) < low:
                continue
            top = _windows(shared, before, n, len(b_))
            for a, e in {x for k in places for x in segments.around(k - i)}:
                if low <= e - a - 1:
                    if (a, e) not in sizes:
                        sizes[a, e] = len(np.unique(mine[a : e - 1]))
                    size = sizes[a, e]
                    if low <= size <= high:
                        top = max(top, 2.0 * len(np.unique(mine[a : e - 1][shared[a : e - 1]])) / (size + len(b_)))
            if top >= least and top > best.get(name, 0.0):
                best[name] = top
        out += [(row, name, dice) for name, dice in best.items()]
    return out


def _previous(pairs: np.ndarray) -> np.ndarray:
    """Where each bigram was last before; -1 where it is the first."""
    order = np.argsort(pairs, kind="stable")
    out = np.full(len(pairs), -1, np.int64)
    same = np.flatnonzero(pairs[order[1:]] == pairs[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def _windows(shared: np.ndarray, before: np.ndarray, n: int, size: int) -> float:
    """Greatest coefficient of the windows of ``n`` bigrams that begin with a bigram of the template.

    A window has a bigram for the first time where it was last before the window's begin, so each
    place counts for a range of windows, and sums over the ends of these ranges give all counts.
    """
    length = len(shared)

    def different(at: np.ndarray) -> np.ndarray:
        begin = np.maximum(before[at] + 1, np.maximum(at - n + 1, 0))
        return np.cumsum(np.bincount(begin, minlength=length + 1) - np.bincount(at + 1, minlength=length + 1))[:length]

    dice = 2.0 * different(np.flatnonzero(shared)) / (different(np.arange(length)) + size)
    return float(dice[shared].max())


_BLANK = re.compile(rb"\n[ \t\r]*\n")


class _Segments:
    """Words of the line, the paragraph and the text around a bigram; a bigram over a segment's end is not in it."""

    def __init__(self, data: bytes, first: np.ndarray) -> None:
        self.first, self.n = first, len(first)
        self.lines = np.flatnonzero(np.frombuffer(data, np.uint8) == 10).tolist()
        self.starts, self.ends = [0], []
        for m in _BLANK.finditer(data):
            self.ends.append(m.start())
            self.starts.append(m.end())
        self.ends.append(len(data))

    def around(self, k: int) -> list[tuple[int, int]]:
        a, b = int(self.first[k]), int(self.first[k + 1])
        out = [(0, self.n)]
        i = bisect.bisect_left(self.lines, a)
        p = bisect.bisect_right(self.starts, a) - 1
        for begin, end in ((self.lines[i - 1] + 1 if i else 0, self.lines[i] if i < len(self.lines) else math.inf), (self.starts[p], self.ends[p])):
            if b < end:
                out.append((int(np.searchsorted(self.first, begin)), self.n if end == math.inf else int(np.searchsorted(self.first, end))))
        return out


def _find(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            found = licences(b.column("text"), least)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())],
                ["doc_id", "license", "dice"],
            )

    return run


def licensed(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, license, dice): a row for each licence of a document."""
    few = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(_find(least), _SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(C.table(spark, sf_dir, "documents"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LOW = f"len(t.b) * {LEAST} / (2 - {LEAST}) - 1e-9"
SQL = f"""
WITH template(license, body) AS (VALUES {", ".join(f"({_literal(n)}, {_literal(t)})" for n, t in TEMPLATES)}),
segment AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents
  UNION ALL SELECT doc_id, text FROM documents),
word AS (SELECT doc_id, regexp_extract_all(lower(s), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM segment WHERE s IS NOT NULL),
bigram AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM word WHERE len(w) > 1),
known AS (
  SELECT license, row_number() OVER () AS t_id, len(w) - 1 AS n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT license, regexp_extract_all(lower(body), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM template)),
whole AS (
  SELECT a.doc_id, t.license, 2.0::DOUBLE * len(list_intersect(a.b, t.b)) / (len(a.b) + len(t.b)) AS dice
  FROM bigram a JOIN known t ON len(a.b) BETWEEN {_LOW} AND len(t.b) * (2 - {LEAST}) / {LEAST} + 1e-9),
spot AS (
  SELECT doc_id, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 1),
hit AS (SELECT s.doc_id, t.t_id, s.pos, s.g FROM spot s JOIN (SELECT t_id, unnest(b) AS g FROM known) t ON s.g = t.g),
likely AS (SELECT doc_id, h.t_id FROM hit h JOIN known t ON h.t_id = t.t_id GROUP BY doc_id, h.t_id, t.b HAVING count(DISTINCT g) >= {_LOW}),
few AS (SELECT h.* FROM hit h JOIN likely l ON h.doc_id = l.doc_id AND h.t_id = l.t_id),
common AS (
  SELECT a.doc_id, a.t_id, a.pos, count(DISTINCT b.g) AS both_ FROM (SELECT DISTINCT doc_id, t_id, pos FROM few) a JOIN known t ON a.t_id = t.t_id
  JOIN few b ON a.doc_id = b.doc_id AND a.t_id = b.t_id AND b.pos BETWEEN a.pos AND a.pos + t.n - 1
  GROUP BY a.doc_id, a.t_id, a.pos, t.b HAVING count(DISTINCT b.g) >= {_LOW}),
window_ AS (
  SELECT c.doc_id, t.license, 2.0::DOUBLE * c.both_ / (count(DISTINCT s.g) + len(t.b)) AS dice FROM common c JOIN known t ON c.t_id = t.t_id
  JOIN spot s ON c.doc_id = s.doc_id AND s.pos BETWEEN c.pos AND c.pos + t.n - 1 GROUP BY c.doc_id, c.t_id, c.pos, c.both_, t.license, t.b)
SELECT doc_id, license, max(dice) AS dice FROM (SELECT * FROM whole UNION ALL SELECT * FROM window_) WHERE dice >= {LEAST} GROUP BY doc_id, license
"""
