"""License texts inside documents, by patience alignment with templates.

Word pairs that a template has once and that stand in a document give diagonals; those close together mark a region.
The region is aligned with the template: words that are unique in both are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between anchors are aligned in the same way,
with equal words at both ends of a gap matched first. The share of matched template words is the
coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import words as w

#: Least coverage of a match, and the least share of a template's word pairs in a region that is aligned.
MIN_COVERAGE, MIN_PAIRS = 0.8, 0.3

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Wordings of public licenses and of notices that name them. (license, text)
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", f"{_BSD} {_BSD_END}"), ("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_END}"), ("Apache-2.0", _APACHE),
    ("GPL-3.0", _GPL), ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched positions of two word sequences, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen_a, seen_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(b[b0:b1], b0) if seen_b[x] == 1}
        anchors = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if seen_a[x] == 1 and x in place]
        if not anchors:
            continue
        chain = rising(anchors)
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        out += chain
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second parts rise."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(i)
        else:
            tails[at], ends[at] = j, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def regions(first: np.ndarray, offset: np.ndarray, length: int, least: int) -> list[tuple[int, int]]:
    """Word ranges where at least ``least`` word pairs of a template of ``length`` words lie on near diagonals."""
    diagonal = np.sort(first - offset)
    starts = np.flatnonzero(np.diff(diagonal, prepend=diagonal[0] - length - 1) > max(2, length // 2))
    stops = np.append(starts[1:], len(diagonal))
    slack = max(2, length // 4)
    return [(int(diagonal[i]) - slack, int(diagonal[j - 1]) + length + slack) for i, j in zip(starts.tolist(), stops.tolist()) if j - i >= least]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] | Mapping[str, str] = tuple(TEMPLATES), min_coverage: float = MIN_COVERAGE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words`` and ``matches`` with license, word range
    (``first``, ``last``, end excluded), ``matched`` words and ``coverage``, in the order of the text.

    Words are lower-cased runs of letters, digits and non-ASCII bytes. Of matches that overlap, the one
    with the most matched words stays (then the higher coverage, the earlier template). Null and empty
    texts have no words and no matches; a template without words matches nothing.
    """
    pairs = list(templates.items()) if isinstance(templates, Mapping) else list(templates)
    names = [n for n, _ in pairs]
    c = w.cut([t.encode() for _, t in pairs], w.ALNUM, lower=True)
    hashes = w.word_hashes(c)
    vocabulary = np.unique(hashes)
    bodies = [np.searchsorted(vocabulary, hashes[a:b]) for a, b in zip(c.first[:-1], c.first[1:])]
    seeds: list[tuple[int, int, int]] = []  # pair of word numbers, template, position
    width = len(vocabulary) + 1
    for t, body in enumerate(bodies):
        if len(body) == 1:
            seeds.append((int(body[0]) * width + width - 1, t, 0))
        own = [int(x) * width + int(y) for x, y in zip(body, body[1:])]
        # A pair that stands twice in the template would also suggest wrong diagonals.
        seen = Counter(own)
        seeds += [(x, t, i) for i, x in enumerate(own) if seen[x] == 1]
    seeds.sort()
    pairs_of = Counter(t for _, t, _ in seeds)
    key, of, at = (np.array(x, dtype=np.int64) for x in zip(*seeds)) if seeds else (np.zeros(0, dtype=np.int64),) * 3
    kind = docs.select(docs[doc_id].alias("doc_id")).schema["doc_id"].dataType.simpleString()
    struct = "array<struct<license:string,first:bigint,last:bigint,matched:bigint,coverage:double>>"
    singles = {int(b[0]) for b in bodies if len(b) == 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in w.chunks(batches, "text"):
            d = w.cut(texts, w.ALNUM, lower=True)
            h = w.word_hashes(d)
            number = np.full(len(h), -1, dtype=np.int64)
            ours = np.flatnonzero(w.member(h, vocabulary))
            number[ours] = np.searchsorted(vocabulary, h[ours])
            last = np.repeat(d.first[1:], d.counts)
            heads = ours[ours + 1 < last[ours]]
            heads = heads[number[heads + 1] >= 0]
            value = number[heads] * width + number[heads + 1]
            alone = ours[np.isin(number[ours], list(singles))] if singles else ours[:0]
            place, value = np.concatenate([heads, alone]), np.concatenate([value, number[alone] * width + width - 1])
            low, high = np.searchsorted(key, value, "left"), np.searchsorted(key, value, "right")
            n = high - low
            place = np.repeat(place, n)
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
            owner, template = np.searchsorted(d.first, place, "right") - 1, of[entry]
            order = np.lexsort((place, template, owner))
            place, entry, owner, template = place[order], entry[order], owner[order], template[order]
            edge = np.flatnonzero(np.diff(owner * len(bodies) + template, prepend=-1)) if len(owner) else []
            found: list[list[tuple]] = [[] for _ in texts]
            for i, j in zip(list(edge), [*list(edge)[1:], len(owner)]):
                doc, t = int(owner[i]), int(template[i])
                body, begin, finish = bodies[t], int(d.first[doc]), int(d.first[doc + 1])
                least = max(1, int(np.ceil(MIN_PAIRS * pairs_of[t])))
                if j - i < least:
                    continue
                for a, b in regions(place[i:j], at[entry[i:j]], len(body), least):
                    a, b = max(a, begin), min(b, finish)
                    pairs = patience(number[a:b].tolist(), body.tolist())
                    if len(pairs) >= min_coverage * len(body):
                        found[doc].append((-len(pairs), -len(pairs) / len(body), t, a + pairs[0][0] - begin, a + pairs[-1][0] + 1 - begin))
            rows = []
            for own in found:
                chosen: list[tuple] = []
                for m in sorted(own):
                    if all(m[4] <= x[3] or m[3] >= x[4] for x in chosen):
                        chosen.append(m)
                rows.append([{"license": names[t], "first": a, "last": b, "matched": -m, "coverage": -s} for m, s, t, a, b in sorted(chosen, key=lambda x: x[3:])])
            kinds = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(d.counts.astype(np.int64)), pa.array(rows, type=kinds)], names=["doc_id", "n_words", "matches"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, matches {struct}")
