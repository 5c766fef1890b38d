"""License scans: a generalised suffix automaton of licence tokens streamed over the texts.

One automaton holds every substring of every template. A text's words stream through it
and give matching statistics: at every word, the length of the longest run ending there
that occurs in some template. Maximal matches are chained, for each template, in the
order of text and template, and the template words that a chain covers make its share. A
file's chains of a template that don't overlap all count; a chain that lies within one of
another template that covers more words is part of that (licences quote each other).
Words outside the templates' vocabulary put the automaton back to its root, so only runs
of known words are streamed; the statistics elsewhere are 0.

The automaton is built from a fixed list of templates, so it has a fixed size and goes to
the tasks with the function. Documents are scanned where they lie: no shuffle.

Defined results: a null or empty text has no words, no places and score 0; first_word and
last_word are null without a place; label columns are empty strings without a label;
repeated rows give equal rows; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common

#: Phrases whose every place counts, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short licences as a whole, of long ones the notices in common use, and phrases, with the labels that a long enough chain over them gives.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
]
#: Matches under MIN_MATCH words are ignored; a chain bridges MAX_GAP words; from MIN_SHARE of a template on its label is given.
MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 30, 0.6

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_OUT = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])))]
)
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, share: double>>"


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words: what stands between the ASCII characters that are no letter or digit."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over token ids; every state knows the ends of its substrings in each template."""

    def __init__(self, templates: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, place of the last word)
        for number, tokens in enumerate(templates):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, size: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The state of the substrings of q that end a shorter match after p; q itself if they are all of q's."""
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._new(self.size[p] + 1)
        self.step[clone] = dict(self.step[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.step[last]:
            return self._split(last, self.step[last][token], token)
        state, p = self._new(self.size[last] + 1), last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = state
            p = self.link[p]
        self.link[state] = 0 if p < 0 else self._split(p, self.step[p][token], token)
        return state

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matches that the next word doesn't lengthen."""
        state = length = 0
        step, link, size = self.step, self.link, self.size
        for i, token in enumerate(tokens):
            if token not in step[state]:
                if length:
                    yield i - 1, length, state
                while state and token not in step[state]:
                    state = link[state]
                length = min(length, size[state])
            if token in step[state]:
                state, length = step[state][token], length + 1
                while size[link[state]] >= length:
                    state = link[state]
        if length:
            yield len(tokens) - 1, length, state


def _apart(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of chains (covered words, first, last) in order of preference those that overlap none before them."""
    taken: list[tuple[int, int]] = []
    out = []
    for c in chains:
        k = bisect.bisect_left(taken, (c[1], c[2]))
        if (k == 0 or taken[k - 1][1] < c[1]) and (k == len(taken) or taken[k][0] > c[2]):
            taken.insert(k, (c[1], c[2]))
            out.append(c)
    return out


def _outer(chains: list[tuple[int, float, int, int, str]]) -> list[tuple[str, int, int, float]]:
    """Of chains (covered words, share, first, last, label) those that don't lie within one that covers more (or as much, but more of its template) or has their label."""
    out: list[tuple[str, int, int, float]] = []
    near: list[tuple[int, float, int, int, str]] = []  # those that may hold the next one
    for c in sorted(chains, key=lambda c: (c[2], -c[3], -c[0], -c[1], c[4])):
        near = [o for o in near if o[3] >= c[2]]
        if not any(c[3] <= o[3] and (o[:2] > c[:2] or o[4] == c[4]) for o in near):
            near.append(c)
            out.append((c[4], c[2], c[3], c[1]))
    return out


class Scanner:
    """Templates and phrases made ready for streaming."""

    def __init__(self) -> None:
        split = [[w for w in words(t)] for _, t in TEMPLATES]
        phrases = {p: words(p) for p in PHRASES}
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for t in [*split, *phrases.values()] for w in t))}
        self.templates = [[self.ids[w] for w in t] for t in split]
        self.labels = [label for label, _ in TEMPLATES]
        self.phrases = {p: [self.ids[w] for w in ws] for p, ws in phrases.items()}
        self.automaton = Automaton(self.templates)

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The chains over the matches that cover MIN_SHARE of a template, as (label, first word, last word, covered share)."""
        spots: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in found:
            for number, place in self.automaton.ends[state]:
                spots.setdefault(number, []).append((end, place, length))
        out: list[tuple[int, float, int, int, str]] = []  # covered words, share, first and last word, label
        for number, own in spots.items():
            own.sort()
            best: list[tuple[int, int]] = []  # covered words and first word of the best chain that ends with a spot
            for k, (end, place, length) in enumerate(own):
                gain, first = length, end - length + 1
                for j in range(k - 1, -1, -1):
                    e, p, _ = own[j]
                    if end - length - e > MAX_GAP:
                        break
                    if e < end and p < place:
                        fresh = min(length, end - e, place - p)
                        if best[j][0] + fresh > gain:
                            gain, first = best[j][0] + fresh, best[j][1]
                best.append((gain, first))
            size = len(self.templates[number])
            enough = [(gain, first, own[k][0]) for k, (gain, first) in enumerate(best) if gain >= MIN_SHARE * size]
            for gain, first, end in _apart(sorted(enough, key=lambda c: (-c[0], c[2], c[1]))):
                out.append((gain, min(1.0, gain / size), first, end, self.labels[number]))
        return _outer(out)

    def scan(self, text: str) -> tuple:
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words(text)], dtype=np.int32)
        n = len(ids)
        starts, base = [], set()
        for phrase, tokens in self.phrases.items():
            if n >= len(tokens):
                hit = ids[: n - len(tokens) + 1] == tokens[0]
                for k, token in enumerate(tokens[1:], 1):
                    hit &= ids[k : n - len(tokens) + 1 + k] == token
                if hit.any():
                    starts.append(np.flatnonzero(hit))
                    base.add(PHRASES[phrase])
        found = []
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for a, b in edge.reshape(-1, 2)[(edge[1::2] - edge[::2]) >= MIN_MATCH]:
            found += [(int(a) + e, length, state) for e, length, state in self.automaton.matches(ids[a:b].tolist()) if length >= MIN_MATCH]
        spans = self.chains(found) if found else []
        score = max([1.0 if base else 0.0, *[s[3] for s in spans]])
        places = np.concatenate(starts) if starts else np.empty(0, int)
        ends = (int(places.min()), int(places.max())) if len(places) else (None, None)
        spans = [dict(zip(("label", "first_word", "last_word", "share"), s, strict=True)) for s in sorted(spans)]
        return n, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in spans})), score, spans


def _run(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _OUT]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)]], schema=schema)

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of every document with its counts, labels, score and covered spans."""
    from pyspark.sql.pandas.types import to_arrow_type

    common.ship(docs.sparkSession)
    df = docs.select(doc_id, F.col(text).cast("string").alias("_scan_text"))
    kind = df.schema[0].dataType
    schema = pa.schema([pa.field("_id", to_arrow_type(kind)), *_OUT])
    return df.mapInArrow(_run(schema), f"_id {kind.simpleString()}, {_DDL}").withColumnRenamed("_id", doc_id)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan of all documents."""
    return scan(common.table(spark, sf_dir, "documents")).drop("spans")


SQL = None
