"""Licences in text: Dice coefficient of word bigrams against licence templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtide.llm.staging import ship

DICE = 0.8
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of"
    " source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific"
    " prior written permission."
)
_BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED'
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,"
    " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR"
    " PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole texts of MIT, ISC and the two BSD licences, and notices that name these and other licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the'
        " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
        ' notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,'
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT"
        " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and"
        ' this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
        " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH"
        " THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License'
        " at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and'
        " limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of"
        " source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_THIRD),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_DISCLAIMER),
)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")
_LINE = re.compile(r"\n")
#: Where a run of pieces can begin and end: at sentences, also over line breaks, and at lines.
_PIECE = re.compile(r"(?<=[.!?])\s+|\n\s*")
_BLANK = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")


def bigrams(text: str) -> Counter:
    """Word bigrams with their counts; words in lower case, ``licence`` as ``license``."""
    words = [w.replace("licence", "license") for w in _WORD.findall(text.lower())]
    return Counter(zip(words, words[1:], strict=False))


def segments(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what is compared: the whole text, its paragraphs, lines and sentences of lines, each place once."""
    seen = set()

    def once(a: int, b: int) -> Iterator[tuple[int, int]]:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a < b and (a, b) not in seen:
            seen.add((a, b))
            yield a, b

    yield from once(0, len(text))
    for splitter in (_BLANK, _LINE):
        at = 0
        for m in splitter.finditer(text):
            yield from once(at, m.start())
            at = m.end()
        yield from once(at, len(text))
    at = 0
    for line in text.split("\n"):
        start = at
        for m in _SENTENCE.finditer(line):
            yield from once(start, at + m.start())
            start = at + m.end()
        yield from once(start, at + len(line))
        at += len(line) + 1


class Matcher:
    """Templates by their bigrams, with the sizes a match can have."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE) -> None:
        self.dice = dice
        self.templates = [(name, grams, sum(grams.values())) for name, text in templates if (grams := bigrams(text))]
        self.by_gram: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for n, (_, grams, _) in enumerate(self.templates):
            for g, c in grams.items():
                self.by_gram.setdefault(g, []).append((n, c))
        # 2 * shared / (a + b) >= dice and shared <= min(a, b) bound a by b
        sizes = [s for *_, s in self.templates]
        self.least, self.most = min(sizes) * dice / (2 - dice), max(sizes) * (2 - dice) / dice
        self.needed = self._needed()

    def _needed(self) -> set[str]:
        """Words of which every match has one: for each template its longest words, enough of them that a segment
        without any shares too few bigrams (each lost word costs up to its own bigrams)."""
        out: set[str] = set()
        for _, grams, size in self.templates:
            # without the chosen words at most the bigrams free of them are shared
            chosen: set[str] = set()
            while 2 * (left := sum(c for g, c in grams.items() if not chosen & {*g})) / (size + left) >= self.dice:
                words = {w for g in grams for w in g} - chosen
                chosen.add(max(words, key=lambda w: (w in out, len(w), w)))
            out |= chosen
        return out

    def best(self, text: str) -> tuple[float, str] | None:
        """The template of highest Dice coefficient, if it reaches the level; of equals the first by name."""
        grams = bigrams(text)
        size = sum(grams.values())
        if not self.least <= size <= self.most:
            return None
        shared: Counter = Counter()
        for g, c in grams.items():
            for n, own in self.by_gram.get(g, ()):
                shared[n] += min(c, own)
        found = [(2 * s / (size + self.templates[n][2]), self.templates[n][0]) for n, s in shared.items()]
        found = [(d, name) for d, name in found if d >= self.dice]
        return min(found, key=lambda x: (-x[0], x[1])) if found else None

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, dice) of matching segments; of nested or overlapping ones the best, then the longest."""
        if not self._possible(text):
            return []
        hits = [(a, b, name, d) for a, b in segments(text) if (m := self.best(text[a:b])) for d, name in [m]]
        hits += self.runs(text)
        hits.sort(key=lambda h: (-h[3], h[0] - h[1], h[0], h[2]))
        out: list[tuple[int, int, str, float]] = []  # disjoint, in order
        for h in hits:
            at = bisect_left(out, h[:2])
            if (not at or out[at - 1][1] <= h[0]) and (at == len(out) or h[1] <= out[at][0]):
                out.insert(at, h)
        return out

    def runs(self, text: str) -> list[tuple[int, int, str, float]]:
        """Matching runs of consecutive pieces (lines, sentences), over line breaks and blank lines.

        Only templates of which the text holds enough bigrams are tried.  A run
        begins and ends in a piece with a bigram of the template, as any other
        one is better without that piece.  It is grown piece by piece, its shared
        bigrams counted on, until it has more bigrams than the template allows.
        """
        found = list(_WORD.finditer(text))
        words = [m[0].lower().replace("licence", "license") for m in found]
        if len(words) < 2:
            return []
        grams = list(zip(words, words[1:], strict=False))
        shared: Counter = Counter()
        for g, c in Counter(grams).items():
            for n, own in self.by_gram.get(g, ()):
                shared[n] += min(c, own)
        tried = [n for n, s in shared.items() if s * (2 - self.dice) >= self.dice * self.templates[n][2] - 1e-9]
        if not tried:
            return []
        # pieces as (first word, past the last word, start, end); those without a word are part of no match
        pieces, at, k = [], 0, 0
        for end, after in [*((m.start(), m.end()) for m in _PIECE.finditer(text)), (len(text), len(text))]:
            first = k
            while k < len(found) and found[k].start() < end:
                k += 1
            if k > first:
                at += len(text[at:end]) - len(text[at:end].lstrip())
                pieces.append((first, k, at, at + len(text[at:end].rstrip())))
            at = after
        hits = []
        for n in tried:
            name, own, size = self.templates[n]
            most = size * (2 - self.dice) / self.dice + 1e-9
            part = [any(grams[g] in own for g in range(max(a - 1, 0), min(b, len(grams)))) for a, b, *_ in pieces]
            for i, (begin, *_, start, _) in enumerate(pieces):
                if not part[i]:
                    continue
                seen: Counter = Counter()
                common, g = 0, begin
                for j in range(i, len(pieces)):
                    _, past, _, end = pieces[j]
                    if past - 1 - begin > most:
                        break
                    while g < past - 1:
                        if (c := own.get(grams[g], 0)) and seen[grams[g]] < c:
                            seen[grams[g]] += 1
                            common += 1
                        g += 1
                    if part[j] and (d := 2 * common / (past - 1 - begin + size)) >= self.dice:
                        hits.append((start, end, name, d))
        return hits

    def _possible(self, text: str) -> bool:
        """Whether some word that a match cannot do without stands in the text."""
        low = text.lower().replace("licence", "license")
        return any(w in low for w in self.needed)


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """``(doc_id, start, end, license, dice)``: one row per licence text or notice in a document.

    A text is compared as a whole, by paragraph, line and sentence, and by runs
    of consecutive lines and sentences (over line breaks and blank lines), with
    words normalised.  A segment whose number of bigrams lies outside of what
    any template allows at this coefficient is never scored, and only templates
    that share a bigram with it are.  Places count code points, end exclusive.

    Texts are whole and go through no shuffle.  Null, empty and one-word texts
    match nothing; repeated rows give their rows each; ties go to the licence
    first by name; a null key is kept; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, dice)
        for batch in batches:
            out = [(n, *hit) for n, body in enumerate(batch.column(1).to_pylist()) for hit in matcher.scan(body)]
            index, *columns = zip(*out, strict=True) if out else ([], [], [], [], [])
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["key", "start", "end", "license", "dice"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, start long, end long, license string, dice double").withColumnRenamed("key", key)
