"""License scans: matching statistics over a generalised suffix automaton of license templates.

The automaton holds every run of words of all templates. A document streams through it word by word; after each word it
knows the longest run ending there that some template has. Where that run cannot grow, a match of `min_match` words or
more is noted, with all its places in each template that holds it. Per template, matches whose places follow one another
in both texts, with gaps of at most `max_gap` document words, form chains; each match continues the chain before it that
covers most of the template (of equal ones the shortest in the document). A chain that covers `coverage` of the template
is a span of that license; of overlapping chains of a template the one that covers most stands, then the first. The
fixed phrases are looked up besides, and their labels always stay.

A null text counts as empty. Spans are in words, end exclusive. Matches look back over `max_gap` words only, so time is
linear in a text, however long. Repeated rows are judged each by itself; columns other than doc_id and text are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, as_bytes, bounded

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public licenses, whole where they are short, else their notices.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2-text": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc0-text": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-notice": "Released under the MIT License.",
}
MIN_MATCH = 4
MAX_GAP = 12
COVERAGE = 0.8

Match = tuple[int, int, int, int]  # start and end in the document, start and end in the template


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty run."""

    def __init__(self, texts: list[list[bytes]], least: int = 1):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        at: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate(texts):
            last = 0
            for place, word in enumerate(words):
                last = self._grow(last, word)
                at.setdefault(last, []).append((number, place + 1))
        # A run ends wherever a longer one ends of which it is the end. Runs under `least` words aren't asked for.
        self.ends: list[list[tuple[int, int]]] = [at.get(k, []) for k in range(len(self.next))]
        for k in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[up := self.link[k]] >= least:
                self.ends[up] = self.ends[up] + self.ends[k]

    def _state(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _fork(self, at: int, word: bytes, to: int) -> int:
        """The state for runs of `to` that are no longer than a step from `at` makes them."""
        if self.length[to] == self.length[at] + 1:
            return to
        twin = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = twin
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def _grow(self, last: int, word: bytes) -> int:
        if (to := self.next[last].get(word)) is not None:
            return self._fork(last, word, to)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._fork(at, word, self.next[at][word])
        return new

    def maximal(self, words: list[bytes], least: int) -> Iterator[tuple[int, int, int]]:
        """(end in the document, words matched, state) wherever the matching statistic stops growing at `least` or more."""
        step, link, length = self.next, self.link, self.length
        state = n = 0
        for place, word in enumerate(words):
            to = step[state].get(word)
            if to is None:
                if n >= least:
                    yield place, n, state
                while state > 0 and to is None:
                    state = link[state]
                    to = step[state].get(word)
                n = length[state] if to is not None else 0
            if to is not None:
                state, n = to, n + 1
        if n >= least:
            yield len(words), n, state


def chains(matches: list[Match], size: int, max_gap: int, coverage: float) -> list[tuple[int, int, float]]:
    """(start, end, share of the template covered) of the best chains that cover enough and don't overlap. Matches come by their ends."""
    best: list[tuple[int, int]] = []  # per match: words that the best chain up to it covers, less its start in the document
    low = 0
    for k, (a, b, s, e) in enumerate(matches):
        top = b - a, -a
        while matches[low][1] < a - max_gap:
            low += 1
        for j in range(low, k):
            _, b0, s0, e0 = matches[j]
            if s0 < s and e0 < e and b0 < b:
                more = b - a - max(0, b0 - a, e0 - s)
                if more > 0 and (best[j][0] + more, best[j][1]) > top:
                    top = best[j][0] + more, best[j][1]
        best.append(top)
    out: list[tuple[int, int, float]] = []
    for k in sorted((k for k, x in enumerate(best) if x[0] >= coverage * size), key=lambda k: (-best[k][0], -best[k][1], matches[k][1])):
        start, end = -best[k][1], matches[k][1]
        at = bisect(out, (start,))
        if (at == len(out) or out[at][0] >= end) and (at == 0 or out[at - 1][1] <= start):
            out.insert(at, (start, end, best[k][0] / size))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, coverage: float = COVERAGE):
        self.labels = list(templates)
        texts = [words_of(x.encode()) for x in templates.values()]
        self.sizes = [len(x) for x in texts]
        self.automaton = Automaton(texts, min_match)
        self.least, self.max_gap, self.coverage = min_match, max_gap, coverage
        self.phrases = [(words_of(p.encode()), label) for p, label in PHRASES.items()]

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        by: dict[int, list[Match]] = {}
        for end, n, state in self.automaton.maximal(words, self.least):
            for template, place in self.automaton.ends[state]:
                by.setdefault(template, []).append((end - n, end, place - n, place))
        return sorted((a, b, self.labels[t], share) for t, found in by.items() for a, b, share in chains(found, self.sizes[t], self.max_gap, self.coverage))

    def phrases_at(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of every place of a base phrase."""
        line = b" " + b" ".join(words) + b" "
        out = []
        for phrase, label in self.phrases:
            want = b" " + b" ".join(phrase) + b" "
            at, upto, count = line.find(want), 0, 0
            while at >= 0:
                count += line.count(b" ", upto, at)
                upto = at
                out.append((count, label))
                at = line.find(want, at + 1)
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, coverage: float = COVERAGE) -> DataFrame:
    """Per document: doc_id, n_words, phrases (start, label) and spans (start, end, label, covered)."""
    bounded(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, min_match, max_gap, coverage)
    phrase, span = pa.struct({"start": pa.int64(), "label": pa.string()}), pa.struct({"start": pa.int64(), "end": pa.int64(), "label": pa.string(), "covered": pa.float64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, phrases, spans = [], [], []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                n.append(len(words))
                phrases.append([{"start": a, "label": x} for a, x in scanner.phrases_at(words)])
                spans.append([{"start": a, "end": b, "label": x, "covered": c} for a, b, x, c in scanner.spans(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(phrases, pa.list_(phrase)), pa.array(spans, pa.list_(span))], ["doc_id", "n_words", "phrases", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, phrases array<struct<start:long,label:string>>, spans array<struct<start:long,end:long,label:string,covered:double>>")
