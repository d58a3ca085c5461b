"""Licence scans: matching statistics against an automaton of licence wording, chained to template spans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import held, id_and_text

#: Phrases whose every place counts, and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Whole licence texts and the notices that stand for longer ones, with the labels that a span of them gives: fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs
and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR
ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
this program. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES = (
    ("mit", MIT), ("isc", ISC), ("bsd-2", f"{BSD_HEAD} {BSD_TAIL}"), ("bsd-3", f"{BSD_HEAD} {BSD_NAMES} {BSD_TAIL}"), ("zlib", ZLIB), ("unlicense", UNLICENSE), ("bsl", BOOST), ("apache", APACHE), ("gpl", GPL),
    ("lgpl", GPL.replace("This program is", "This library is").replace("General", "Lesser General").replace("this program", "this library")),
    ("agpl", GPL.replace("General", "Affero General")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "licensed under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Shortest match that is chained, most document words between two chained matches, share of a template that gives its label.
MATCH_WORDS, GAP_WORDS, COVERED = 3, 12, 0.8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class LicenceScanner:
    """The automaton of all phrases and templates; tokens are numbers of their words."""

    def __init__(self, templates=TEMPLATES, phrases=None):
        self.phrases = dict(PHRASES if phrases is None else phrases)
        self.templates = [(label, words(t.encode())) for label, t in templates]
        own = [words(p.encode()) for p in self.phrases]
        vocabulary = sorted({w for t in (*(t for _, t in self.templates), *own) for w in t})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        coded = [[self.number[w] for w in t] for _, t in self.templates]
        self.automaton = SuffixAutomaton()
        for t in (*coded, *([self.number[w] for w in p] for p in own)):
            self.automaton.add(t)
        link, length = self.automaton.link, self.automaton.length
        #: each state's templates with the places (ends) of its strings in them, and the phrases that its strings end in
        self.places: list[dict[int, list[int]]] = [{} for _ in link]
        for k, t in enumerate(coded):
            for state, end in zip(self._prefixes(t), range(1, len(t) + 1), strict=True):
                self.places[state].setdefault(k, []).append(end)
        self.ends: list[list[tuple[int, str]]] = [[] for _ in link]
        for p, label in zip(own, self.phrases.values(), strict=True):
            if p:
                self.ends[self._prefixes([self.number[w] for w in p])[-1]].append((len(p), label))
        by_length = sorted(range(1, len(link)), key=length.__getitem__)
        for v in reversed(by_length):
            for k, at in self.places[v].items():
                self.places[link[v]][k] = sorted({*self.places[link[v]].get(k, ()), *at})
        #: for each state the (template, state) whose strings are its longest suffixes that the template has
        self.longest: list[dict[int, int]] = [{} for _ in link]
        for v in by_length:
            self.ends[v] = self.ends[v] + self.ends[link[v]]
            above = self.longest[link[v]] if length[link[v]] >= MATCH_WORDS else {}
            self.longest[v] = above | dict.fromkeys(self.places[v], v)
        #: runs of fewer known words hold nothing
        self.least = min([MATCH_WORDS, *(len(p) for p in own if p)])

    def _prefixes(self, tokens: list[int]) -> list[int]:
        """The states of the prefixes of an added sequence."""
        state = matched = 0
        out = []
        for t in tokens:
            state, matched = self.automaton.step(state, matched, t)
            out.append(state)
        return out

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Phrase places (start, length, label) and template spans (start, end, label, share covered)."""
        ids = np.fromiter(map(self.number.get, ws, [-1] * len(ws)), np.int64, len(ws))
        known = np.flatnonzero(ids >= 0)
        found: list[tuple[int, int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        if len(known):
            for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
                if len(run) >= self.least:
                    self._stream(ids[run].tolist(), int(run[0]), found, matches)
        return found, _outermost([(n, *s) for k, own in matches.items() for n, s in self._spans(k, own)])

    def _stream(self, tokens: list[int], base: int, found: list, matches: dict) -> None:
        """Phrases and, for each template, the matches (start, end, end in the template) that can't be made longer."""
        step, ends, length = self.automaton.step, self.ends, self.automaton.length
        state = matched = 0
        open_: dict[int, tuple[int, int]] = {}  # per template the length of its match that ends here, and the match's state
        for i, t in enumerate(tokens):
            state, matched = step(state, matched, t)
            now = {k: (matched if v == state else length[v], v) for k, v in self.longest[state].items()} if matched >= MATCH_WORDS else {}
            if open_:
                self._close({k: x for k, x in open_.items() if k not in now or now[k][0] != x[0] + 1}, base + i, matches)
            open_ = now
            for n, label in ends[state]:
                if matched >= n:
                    found.append((base + i + 1 - n, n, label))
        self._close(open_, base + len(tokens), matches)

    def _close(self, over: dict[int, tuple[int, int]], end: int, matches: dict) -> None:
        for k, (n, state) in over.items():
            matches.setdefault(k, []).extend((end - n, end, at) for at in self.places[state][k])

    def _spans(self, k: int, own: list[tuple[int, int, int]]) -> Iterator[tuple[int, tuple[int, int, str, float]]]:
        """The chains of one template's matches that cover enough of it, with the words covered, the best first and others where they don't overlap it.

        In a chain document and template both go forwards and gaps in the document are short; what two matches share counts
        once. ``best`` is the most words that a chain up to each match covers.
        """
        label, template = self.templates[k]
        own = sorted(set(own), key=lambda m: (m[1], m[0], m[2]))
        best: list[tuple[int, int]] = []  # words covered, start of the chain
        for j, (start, end, at) in enumerate(own):
            top = (end - start, start)
            i = j - 1
            while i >= 0 and own[i][1] >= start - GAP_WORDS:
                _, before, passed = own[i]
                new = end - start - max(0, before - start, passed - (at - (end - start)))
                if before < end and passed < at and new > 0:
                    top = max(top, (best[i][0] + new, best[i][1]))
                i -= 1
            best.append(top)
        taken: list[int] = []  # the edges of the spans taken, in order: an even number lies before a free place
        for (n, start), (_, end, _) in sorted(zip(best, own, strict=True), key=lambda x: (-x[0][0], x[1][1] - x[0][1], x[0][1])):
            if n < COVERED * len(template):
                break
            at = bisect_right(taken, start)
            if at % 2 == 0 and bisect_left(taken, end) == at:
                taken[at:at] = (start, end)
                yield n, (start, end, label, n / len(template))


def _outermost(spans: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Spans (words covered, start, end, label, share) without those inside one that covers more words, or as many and more of its template.

    Spans are met by start, longer ones first, so those that hold one are among the earlier. Of the earlier ones a stack
    keeps what can still hold a later span: one that ends no later than another and weighs no more is never needed.
    """
    best: list[tuple[int, tuple[int, float]]] = []  # ends fall, weights rise from the front
    out = []
    for start, group in groupby(sorted(spans, key=lambda s: (s[1], -s[2])), key=lambda s: s[1:3]):
        own = list(group)
        end, weight = start[1], max((s[0], s[4]) for s in own)
        at = bisect_right(best, -end, key=lambda x: -x[0])  # those before end no earlier
        above = max(weight, best[at - 1][1]) if at else weight
        out += [s[1:] for s in own if (s[0], s[4]) == above]
        if not at or best[at - 1][1] < weight:
            rest = at
            while rest < len(best) and best[rest][1] <= weight:
                rest += 1
            best[at:rest] = [(end, weight)]
    return out


_OUT = "doc_id long, n_words long, phrases array<struct<start:long,length:long,label:string>>, spans array<struct<start:long,end:long,label:string,covered:double>>"
_FIELDS = (
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("phrases", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))),
)


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple, phrases: tuple) -> Iterator[pa.RecordBatch]:
    scanner = held("licenses", (templates, phrases), lambda: LicenceScanner(templates, dict(phrases)))
    for b in batches:
        counts, found, spans = [], [], []
        for x in b.column(1):
            ws = words(x.as_py())
            p, s = scanner.scan(ws)
            counts.append(len(ws))
            found.append([{"start": a, "length": n, "label": label} for a, n, label in p])
            spans.append([{"start": a, "end": e, "label": label, "covered": c} for a, e, label, c in s])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, _FIELDS[2][1]), pa.array(spans, _FIELDS[3][1])], schema=pa.schema(_FIELDS))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, phrases (start, length, label), spans (start, end, label, covered).

    ``phrases`` are all places of the fixed phrases, in words from 0; one word may be a phrase. ``spans`` are the chains of
    matches of MATCH_WORDS or more words with one template's wording that cover most of it, COVERED at least; words may be
    added, repeated or left out between matches, up to GAP_WORDS in the document. Of chains of one template that overlap
    the one that covers most is told, then the shortest, then the first. A document may hold spans of several templates; one
    inside a span that covers more words, or as many and more of its template, is left out, as wording that differs in a few words stands in several licences.

    Null and empty texts have no words and nothing found; very long texts are streamed through the automaton whole; repeated
    rows give a row each; an empty table gives no rows; other columns, whatever their names, are ignored. The automaton is
    made from the templates where tasks run and doesn't grow with the data.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.encode("text", "UTF-8"))
    return rows.mapInArrow(partial(_scan, templates=tuple(map(tuple, templates)), phrases=tuple((PHRASES if phrases is None else phrases).items())), _OUT)
