"""License scans by winnowed fingerprints and banded alignment (operator 5).

Templates are lower-case words. Hashes of their runs of `K` words are winnowed (the least of every `WINDOW`
neighbouring hashes is a fingerprint) into an inverted index: fingerprint -> template and position. All runs of a
document are looked up, so any run of K + WINDOW - 1 words that it shares with a template is found. Hits of one template
that stand close together and go forward in document and template are chained to one candidate, whose diagonal may drift, as it does where a long name or a sentence stands
in a license; where the template begins again, another candidate does. Candidates whose hits leave so much of the template without a fingerprint that they can't reach
`min_coverage` go without being aligned, so repeated phrases are cheap. The band is as wide as a candidate's diagonals and BAND on both sides. A banded alignment of the whole template (match 1, mismatch and gap -1), row by row for all of the band at once, gives the matched words, their share of the template (coverage) and the
span in the text. Candidates below `min_coverage` are dropped; each occurrence is a row.

Templates are a parameter, a tuple or a DataFrame of license and text; they are broadcast, and of over `most_words` words refused. Documents are scanned in place and never shuffled.
Edge cases. Null and empty texts have no match; templates of under K words match nothing. Of matches that
overlap in the text, the one with most matched words stays, then the one with the highest coverage, then the first template: a license with a clause more than another is also that one with an insertion. Very long texts are read whole; repeated rows are each reported. Columns beside id and text are not read, so their names may
clash with the results'.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .tokens import WORD, SeedIndex, Vocabulary, seed_hashes, words

K, WINDOW, BAND = 3, 2, 8
#: A candidate's diagonals may drift by a DRIFT-th of the template's words from one hit to the next, and by twice that in all.
DRIFT = 4
#: Alignments that are kept while one text is scanned for one template: repeated passages are aligned once.
KNOWN = 1 << 12
MATCH = ArrayType(StructType([StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("n_matched", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))

# fixed values: the public texts of short licenses, whole, and the notices by which long ones are applied
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_GNU = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."""
_GNU_SHORT = """under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives"}
_GNUS = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}

#: Well-known licenses: name, text. One may have several, a line that names it, its notice or its whole text.
TEMPLATES = (
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    *[(name, _GNU.format("program" if kind != "Lesser " else "library", ":" if n == "3" else ";", kind, "," if n == "3" else ";", n)) for name, (kind, n) in _GNUS.items()],
    *[(name, _GNU_SHORT.format(kind, n)) for name, (kind, n) in _GNUS.items()],
    *[(name, f"This work is licensed under the GNU {kind}General Public License, version {n}.") for name, (kind, n) in _GNUS.items()],
    *[(name, f"This work is licensed under a Creative Commons {kind} 4.0 International License.") for name, kind in _CC.items()],
    *[(name, f"Licensed under {name.replace('CC-', 'CC ').replace('-4.0', ' 4.0')}.") for name in _CC],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the fingerprints: the rightmost least hash of each window."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(1))


def along(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int) -> np.ndarray:
    """The document's words along a band, -1 outside."""
    near = np.full(len(template) + 2 * band + 1, -1, np.int64)
    low = diagonal - band
    a, b = max(0, -low), min(len(near), len(doc) - low)
    if a < b:
        near[a:b] = doc[low + a : low + b]
    return near


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int, known: dict[bytes, list[tuple[int, int]]] | None = None) -> list[tuple[int, int]]:
    """Matched (template, document) positions of the best alignment of the whole template near a diagonal (document minus template position). Words before and after it in the document are free. known: alignments of this template by band and words along it, which this one is looked up in and added to."""
    near = along(template, doc, diagonal, band)
    key = near.tobytes()
    if known is None or key not in known:
        found = _aligned(template, near, band)
        if known is None:
            return [(i, j + diagonal) for i, j in found]
        if len(known) >= KNOWN:
            known.clear()
        known[key] = found
    return [(i, j + diagonal) for i, j in known[key]]


def _aligned(template: np.ndarray, near: np.ndarray, band: int) -> list[tuple[int, int]]:
    width, n = 2 * band + 1, len(template)
    at = np.arange(width)
    score, moves = np.zeros(width, np.int64), np.zeros((n, width), np.int8)
    for i in range(n):
        same = near[i : i + width] == template[i]
        new, move = score + np.where(same, 1, -1), np.where(same, 1, 2)
        left = np.append(score[1:] - 1, -(1 << 40))  # a word of the template is left out
        better = left > new
        new, move = np.where(better, left, new), np.where(better, 3, move)
        # words of the document are left out: each costs 1, so the best start for b is a running maximum
        reach = np.maximum.accumulate(new + at) - at
        move[reach > new] = 4
        score, moves[i] = reach, move
    i, b, out = n - 1, max(range(width), key=lambda x: (score[x], -abs(x - band))), []
    while i >= 0:
        how = moves[i][b]
        if how == 1:
            out.append((i, i + b - band))
        if how == 3:
            i, b = i - 1, b + 1
        elif how == 4:
            b -= 1
        else:
            i -= 1
    return out[::-1]


def may_reach(hits: np.ndarray, size: int, coverage: float) -> bool:
    """Whether a template of so many words can be covered that far where only these of its runs are hit. Where none is, no K + WINDOW - 1 words in a row match, so of so many words one at least is missing."""
    ends = np.concatenate([[-K], np.unique(hits), [size]])
    free = np.maximum(0, np.diff(ends) - K)
    return (free // (K + WINDOW - 1)).sum() <= size - coverage * size


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], min_coverage: float):
        self.min_coverage = min_coverage
        self.names = [n for n, _ in templates]
        texts = [words(t) for _, t in templates]
        self.vocabulary = Vocabulary(texts)
        self.templates = [self.vocabulary.of(w) for w in texts]
        self.mask = tuple(range(K))
        found = []
        for i, ids in enumerate(self.templates):
            at, h = seed_hashes(ids, self.mask)
            keep = winnow(h)
            found.append((h[keep], np.full(len(keep), i), at[keep]))
        self.index = SeedIndex(*(np.concatenate(x) for x in zip(*found))) if found else SeedIndex(*[np.zeros(0, k) for k in (np.uint64, np.int64, np.int64)])

    def _groups(self, at: np.ndarray, there: np.ndarray, size: int) -> list[tuple[int, int]]:
        """Least and largest diagonal of each candidate among one template's hits (places in the document and in the template), without those that can't reach the coverage."""
        done: list[list[int]] = []
        # may go on, by last place in the template, the latest of equal ones: last places in document and template, least and largest diagonal, hits
        open_: dict[int, list[int]] = {}
        drift = max(BAND, size // DRIFT)
        for p, q in sorted(zip(at.tolist(), there.tolist())):
            best, most = None, None
            for k, g in list(open_.items()):
                if p - g[0] > size + drift:
                    del open_[k]
                elif q > k and p > g[0]:
                    by = abs(p - q - (g[0] - k))
                    # the longest chain goes on, less a hit for each word of drift: strays in repeated phrases are short
                    if by <= drift and max(g[3], p - q) - min(g[2], p - q) <= 2 * drift and (most is None or g[4] - by > most):
                        best, most = g, g[4] - by
            if best is not None:
                del open_[best[1]]
                best[:] = p, q, min(best[2], p - q), max(best[3], p - q), best[4] + 1
            else:
                best = [p, q, p - q, p - q, 1]
                done.append(best)
            if q not in open_ or open_[q][4] <= best[4] or p - open_[q][0] > drift:
                open_[q] = best
        # an alignment sees the hits of its diagonals only
        order = np.argsort(at - there, kind="stable")
        diagonals, places = (at - there)[order], there[order]
        out = set()
        for _, _, low, high, _ in done:
            half = BAND + (high - low + 1) // 2
            a, b = np.searchsorted(diagonals, [(low + high) // 2 - half, (low + high) // 2 + half + 1])
            if may_reach(places[a:b], size, self.min_coverage):
                out.add((low, high))
        return sorted(out)

    def scan(self, text: str | None) -> list[dict]:
        if not text or not len(self.index.hits(*seed_hashes(self.vocabulary.of(words(text)), self.mask))[0]):
            return []
        places = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
        ids = self.vocabulary.of([w for _, _, w in places])
        at, which, there = self.index.hits(*seed_hashes(ids, self.mask))
        found: dict[tuple[int, int, int], dict] = {}
        for t in np.unique(which).tolist():
            template = self.templates[t]
            mine, known = which == t, {}
            for low, high in self._groups(at[mine], there[mine], len(template)):
                band = BAND + (high - low + 1) // 2
                pairs = align(template, ids, (low + high) // 2, band, known)
                if pairs and len(pairs) >= self.min_coverage * len(template):
                    start, end = places[pairs[0][1]][0], places[pairs[-1][1]][1]
                    found[t, start, end] = {"license": self.names[t], "coverage": len(pairs) / len(template), "n_matched": len(pairs), "start": start, "end": end}
        kept: list[tuple[int, int]] = []  # disjoint spans by start; of matches that overlap, the best stays
        for k in sorted(found, key=lambda k: (-found[k]["n_matched"], -found[k]["coverage"], k)):
            i = bisect_left(kept, (k[2], -1))
            if not i or kept[i - 1][1] <= k[1]:
                kept.insert(i, (k[1], k[2]))
            else:
                del found[k]
        return sorted(found.values(), key=lambda x: x["start"])


def template_rows(templates: tuple[tuple[str, str], ...] | DataFrame, most_words: int) -> tuple[tuple[str, str], ...]:
    if isinstance(templates, DataFrame):
        known = templates.filter("license is not null and text is not null")
        n = known.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
        if n > most_words:
            raise ValueError(f"the templates have {n} words; at most {most_words} are broadcast")
        return tuple(sorted((r["license"], r["text"]) for r in known.select("license", "text").collect()))
    return templates


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES, min_coverage: float = 0.8, most_words: int = 2_000_000) -> DataFrame:
    """A row per match: doc_id, license, coverage, n_matched (words), start and end (code points of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(template_rows(templates, most_words), min_coverage))

    @F.pandas_udf(MATCH)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.scan(x) for x in batch])

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(scan(F.col(text_col))).alias("m")).select("doc_id", "m.*")


def op5(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
