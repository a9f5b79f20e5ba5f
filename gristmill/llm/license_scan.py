"""License scans by patience alignment.

A template and a text are aligned on the words that occur once in each: the
longest increasing run of such anchors is kept, and the gaps between anchors
are aligned in the same way, down to equal words at a gap's ends.  The share of
a template's words that find their place in the text is its coverage.  As a text
that repeats a notice has few words that occur once, windows are cut first, from
every place where a copy may begin, and each is aligned by itself; a gap without
words that occur once takes those that occur equally often on both sides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches
from ._text import NOT_LETTER, Words, slabs

#: Least coverage of a template that is reported.
MIN_COVERAGE = 0.8
#: Aligned words may stand this many times further apart than in the template.
MAX_STRETCH = 2.0

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either "
    "version {1} of the License, or (at your option) any later version."
)
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License."

#: Whole texts of the short public licenses, and the notices by which works name any license.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _MIT_GRANT,
        _MIT_GRANT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("GNU General Public License", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format("GNU General Public License", "2")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("GNU Lesser General Public License", "3")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format("GNU Lesser General Public License", "2.1")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("GNU Affero General Public License", "3")],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "BSD-2-Clause": [_BSD_TWO + _BSD_DISCLAIMER],
    "BSD-3-Clause": [_BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is marked with CC0 1.0 Universal.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("Attribution")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial")],
}

#: Words are runs of letters, digits and bytes of other characters.
_SEP = NOT_LETTER.copy()
_SEP[48:58] = False


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of the first) whose second grows."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(tails, j)
        back[k] = at[i - 1] if i else -1
        if i == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[i], at[i] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _paired(a: list[int], b: list[int], part: tuple[int, int, int, int], items: set[int]) -> list[tuple[int, int]]:
    """(i, j) of each occurrence in a part of a with the same one in a part of b, of items that are as often in both."""
    a0, a1, b0, b1 = part
    where: dict[int, list[int]] = {}
    for j in range(b1 - 1, b0 - 1, -1):
        if b[j] in items:
            where.setdefault(b[j], []).append(j)
    return [(i, where[a[i]].pop()) for i in range(a0, a1) if a[i] in items]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of equal items, both increasing, by patience alignment."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        anchors = _paired(a, b, (a0, a1, b0, b1), {x for x, n in in_a.items() if n == in_b[x] == 1}) or _paired(a, b, (a0, a1, b0, b1), {x for x, n in in_a.items() if n == in_b[x]})
        kept = _longest_increasing(anchors)
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k - i > 1 and m - j > 1]
    return sorted(out)


def windows(a: list[int], b: list[int], places: list[int], least: int, stretch: float = MAX_STRETCH) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, bound): windows b[lo:hi] in which `least` items of a may be matched; bound: no more of them can be.

    b: the items of a text that are in a, at ascending `places`.  A window begins
    where a copy may begin, at one of the first items of a of which `least`
    still follow, and ends stretch * len(a) (and 8) places on; or before that,
    where an item that a has once comes again.
    """
    reach = max(8, int(stretch * len(a)))
    wanted, opening = Counter(a), set(a[: len(a) - least + 1])
    # of each item that a has once, the next place in b
    again, after = [len(b)] * (len(b) + 1), {}
    for k in range(len(b) - 1, -1, -1):
        again[k] = min(again[k + 1], after.get(b[k], len(b)) if wanted[b[k]] == 1 else len(b))
        after[b[k]] = k
    bound, hi = 0, 0
    have: Counter[int] = Counter()
    for lo, x in enumerate(b):
        while hi < len(b) and places[hi] - places[lo] < reach:
            bound += have[b[hi]] < wanted[b[hi]]
            have[b[hi]] += 1
            hi += 1
        if bound >= least and x in opening:
            if again[lo] < hi and again[lo] - lo >= least:
                yield lo, again[lo], min(bound, again[lo] - lo)
            yield lo, hi, bound
        have[x] -= 1
        bound -= have[x] < wanted[x]


def _keys(text: str) -> np.ndarray:
    return Words(pa.array([text]), sep=_SEP).key


class _Scanner:
    """Templates as word keys, with the words that tell whether a text is worth aligning."""

    def __init__(self, templates: dict[str, list[str]], coverage: float):
        self.items = [(name, k, _keys(t)) for name, texts in templates.items() for k, t in enumerate(texts)]
        self.known = np.unique(np.concatenate([k for *_, k in self.items])) if self.items else np.zeros(0, np.uint64)
        self.coverage = coverage
        self.wanted = [Counter(k.tolist()) for *_, k in self.items]
        # how often each known word (row) is in each template (column)
        self.table = np.array([[c[x] for c in self.wanted] for x in self.known.tolist()], np.int64).reshape(len(self.known), len(self.items))
        self.least = np.array([coverage * len(k) for *_, k in self.items])

    def scan(self, column: pa.Array) -> list[list[dict]]:
        w = Words(column, sep=_SEP)
        out: list[list[dict]] = [[] for _ in range(w.n)]
        if not len(self.known):
            return out
        word = np.minimum(np.searchsorted(self.known, w.key), len(self.known) - 1)
        places = np.flatnonzero(self.known[word] == w.key)
        cut = np.searchsorted(w.doc[places], np.arange(w.n + 1))
        # a text lacks a template if it lacks more of its words than coverage allows: at first, however often it has each
        pair = np.unique(w.doc[places] * len(self.known) + word[places])
        doc, first = np.unique(pair // len(self.known), return_index=True)
        most = np.add.reduceat(self.table[pair % len(self.known)], first, axis=0) if len(doc) else np.zeros((0, len(self.items)), np.int64)
        for row in np.flatnonzero((most >= self.least).any(axis=1)).tolist():
            i = int(doc[row])
            at = places[cut[i] : cut[i + 1]]
            have = Counter(w.key[at].tolist())
            for t in np.flatnonzero(most[row] >= self.least).tolist():
                name, k, keys = self.items[t]
                if sum(min(n, have[x]) for x, n in self.wanted[t].items()) < self.least[t]:
                    continue
                found = self._place(w, i, at, keys)
                if found is not None:
                    out[i].append({"license": name, "template": k, **found})
        return out

    def _place(self, w: Words, i: int, at: np.ndarray, keys: np.ndarray) -> dict | None:
        """The first place with most words of a template aligned, in the windows of each of the text's runs of its words."""
        mine = at[np.isin(w.key[at], keys)]
        reach = max(8, int(MAX_STRETCH * len(keys)))
        runs = np.split(mine, np.flatnonzero(np.diff(mine) >= reach) + 1)
        a, least = keys.tolist(), max(1, ceil(self.coverage * len(keys) - 1e-9))
        best, found = least - 1, None
        for run in runs:
            if len(run) < least:
                continue
            b = w.key[run].tolist()
            for lo, hi, bound in windows(a, b, run.tolist(), least):
                if bound <= best:
                    continue
                matched = align(a, b[lo:hi])
                if len(matched) > best:
                    best, found = len(matched), (int(run[lo + matched[0][1]]), int(run[lo + matched[-1][1]]))
                if best == len(a):
                    break
            if best == len(a):
                break
        if found is None:
            return None
        base = w.doc_off[i]
        return {"coverage": best / len(a), "words": best, "first_byte": int(w.start[found[0]] - base), "end_byte": int(w.end[found[1]] - base)}


FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("template", T.IntegerType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("words", T.IntegerType()),
            T.StructField("first_byte", T.LongType()),
            T.StructField("end_byte", T.LongType()),
        ]
    )
)


def read_templates(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Templates of a folder of license texts, one a file, by the file's name without its ending; the caller bounds their number."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt|\.md)?$", 1).alias("name"), "value")
    return {r.name: [r.value] for r in files.orderBy("name").collect()}


def scan_licenses(
    docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] | None = None, coverage: float = MIN_COVERAGE
) -> DataFrame:
    """One row for each document: doc_id, n_found, found.

    found lists every template with at least `coverage` of its words aligned in
    the text by patience alignment, with the best place.  Case and punctuation do not count.  A null
    or empty text has none; repeated rows are scanned each.  Large templates
    and texts are aligned whole; the templates travel with the task and are the
    caller's to bound.
    """
    scanner = _Scanner(TEMPLATES if templates is None else templates, coverage)
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("found", FOUND)])
    kind = pa.list_(
        pa.struct(
            [
                ("license", pa.string()),
                ("template", pa.int32()),
                ("coverage", pa.float64()),
                ("words", pa.int32()),
                ("first_byte", pa.int64()),
                ("end_byte", pa.int64()),
            ]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column(1)):
                found = scanner.scan(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, kind)], schema.names)

    out = map_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), "found")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document: doc_id, license, coverage, n_found, first_byte, end_byte.

    license is the best covered one, of the most aligned words, first by name; null if there is none.
    Nulls, equal rows and empty tables: as in scan_licenses.
    """
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rank = F.transform("found", lambda x: F.struct((-x["coverage"]).alias("a"), (-x["words"]).alias("b"), x["license"].alias("license"), x.alias("x")))
    best = F.try_element_at(F.array_sort(rank), F.lit(1))["x"]
    return found.withColumn("best", best).select("doc_id", "best.license", "best.coverage", "n_found", "best.first_byte", "best.end_byte")
