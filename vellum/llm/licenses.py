"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Words are runs of letters, digits and bytes above 0x7F, A-Z lower-cased, so punctuation and
layout don't matter. A template's k-word hashes are winnowed into an inverted index, which is
small and fixed. Every k-word hash of a text is looked up in it; hits on near diagonals form a
candidate, and only there template and text are aligned within a band. A match reports the
share of the template's words found in order, and the span in code points.

A template of fewer than `SHORT` words has all its pairs of words in an index of their own, as
coverage may leave no longer run whole. Texts are aligned on each diagonal of these hits, if the
words around hold enough of the template's, and of matches that overlap the best stays.

Cases: null, empty and blank texts have no match. Every occurrence in a text is a row, the
templates of one place are told apart by coverage, and ties go to the earlier template. Rows
are independent, so repeated rows and null ids give repeated rows. A very long text is scanned
whole, by itself. Columns other than id and text are never read, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import mix64, slices, text_bytes, word_hashes, word_spans

GRAM, WINNOW = 4, 3
#: Templates of fewer words are found by pairs of words.
SHORT, PAIR = 20, 2
BAND = 12
LEAST_COVERAGE = 0.8

#: Public notices as they are put into files.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT-line": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-line": "under the terms of the GNU General Public License",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-or-later": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_TABLE = np.zeros(256, bool)
_TABLE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, start and end bytes, first word of each text, and the texts' byte offsets."""
    raw, at = text_bytes(texts)
    starts, ends, first = word_spans(raw, at, _TABLE)
    return word_hashes(raw, starts, ends), starts, ends, first, at


def grams(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)])
    return rolled


def winnow(codes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the least code of every `window` neighbours (all codes, if there are fewer), the last of equals."""
    picked = {i + window - 1 - int(np.argmin(codes[i : i + window][::-1])) for i in range(len(codes) - window + 1)}
    return np.array(sorted(picked or range(len(codes))), np.int64)


class Index:
    """Fingerprints of templates: code -> (template, place). Winnowed runs, or all pairs of the short templates."""

    def __init__(self, templates: Mapping[str, str], short: bool = False):
        self.names = list(templates)
        self.words = [words(pa.array([t], pa.large_string()))[0] for t in templates.values()]
        # A short template may follow itself, so its band is a part of its length.
        self.bands = np.array([min(BAND, max(2, len(w) // 3)) for w in self.words])
        self.size = PAIR if short else GRAM
        self.short = None if short else Index(templates, short=True)
        entries = []
        for t, hashes in enumerate(self.words):
            if (len(hashes) < SHORT) != short:
                continue
            codes = grams(hashes, self.size)
            entries += [(int(codes[i]), t, int(i)) for i in (range(len(codes)) if short else winnow(codes))]
        entries.sort()
        self.codes = np.array([e[0] for e in entries], np.uint64)
        self.template = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among codes, and the template and place that each meets."""
        lo, hi = np.searchsorted(self.codes, codes, "left"), np.searchsorted(self.codes, codes, "right")
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        entry = np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(found, n), self.template[entry], self.place[entry]


@cache
def _index() -> Index:
    return Index(TEMPLATES)


def align(template: np.ndarray, text: list[int], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order near the diagonal text = template + shift, and the first and last place in text.

    Of equal counts, the match that starts last and then ends first: the tightest span.
    """
    none = (0, 0, 0)
    row: list[tuple[int, int, int]] = [none] * (2 * band + 3)
    best = none
    for i, word in enumerate(template.tolist()):
        new = [none] * len(row)
        for d in range(1, 2 * band + 2):
            j = i + shift + d - band - 1
            top = max(row[d + 1], new[d - 1])
            if 0 <= j < len(text) and text[j] == word:
                n, first, _ = row[d]
                top = max(top, (n + 1, first if n else j, -j))
            new[d] = top
        row = new
        best = max(best, *row)
    return best[0], best[1], -best[2]


def matches(index: Index, hashes: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """(template, coverage, first word, last word) of every occurrence in one text's words."""
    at, template, place = index.hits(grams(hashes))
    found: list[tuple[int, float, int, int]] = []
    if len(at):
        order = np.lexsort((at, at - place, template))
        at, template, diagonal = at[order], template[order], (at - place)[order]
        opens = np.flatnonzero(np.concatenate([[True], (template[1:] != template[:-1]) | (np.diff(diagonal) > index.bands[template[1:]])]))
        for a, b in zip(opens, [*opens[1:], len(at)], strict=True):
            found += _aligned(index, int(template[a]), hashes, int(np.median(diagonal[a:b])), least)
    found += _short_matches(index.short, hashes, least)
    return sorted(set(found), key=lambda x: (x[2], -x[1], x[0]))


def _aligned(index: Index, t: int, hashes: np.ndarray, shift: int, least: float) -> list[tuple[int, float, int, int]]:
    """The match of a template near a diagonal, if it covers enough."""
    own, band = index.words[t], int(index.bands[t])
    low = max(0, shift - band)
    text = hashes[low : max(0, shift + len(own) + band)]
    if np.isin(own, text).sum() < least * len(own):
        return []
    n, first, last = align(own, text.tolist(), shift - low, band)
    return [(t, n / len(own), low + first, low + last)] if n >= least * len(own) else []


def _short_matches(index: Index, hashes: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    at, template, place = index.hits(grams(hashes, PAIR))
    seen = sorted(set(zip(template.tolist(), (at - place).tolist(), strict=True)))
    near = [x for t, shift in seen for x in _aligned(index, t, hashes, shift, least)]
    found: list[tuple[int, float, int, int]] = []
    taken: dict[int, np.ndarray] = {}
    for t, coverage, first, last in sorted(set(near), key=lambda x: (x[0], -x[1], x[3] - x[2], x[2])):
        free = taken.setdefault(t, np.ones(len(hashes), bool))
        if free[first : last + 1].all():
            free[first : last + 1] = False
            found.append((t, coverage, first, last))
    return found


def _scan(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                hashes, starts, ends, first, at = words(texts)
                places = np.concatenate([i.hits(grams(hashes, i.size))[0] for i in (index, index.short)])
                hit = np.unique(np.searchsorted(first, places, "right") - 1)
                ids = part.column("doc_id").to_pylist()
                rows = []
                for d in hit.tolist():
                    a, b = first[d], first[d + 1]
                    raw = None
                    for t, coverage, one, two in matches(index, hashes[a:b], least):
                        raw = texts[d].as_py().encode() if raw is None else raw
                        left = len(raw[: starts[a + one] - at[d]].decode())
                        right = left + len(raw[starts[a + one] - at[d] : ends[a + two] - at[d]].decode())
                        rows.append((ids[d], index.names[t], coverage, left, right))
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "license", "coverage", "start", "end"])

    return run


def scan_licenses(docs: DataFrame, least_coverage: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, start, end (code points, end exclusive) of every match. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(least_coverage), "doc_id long, license string, coverage double, start long, end long")
