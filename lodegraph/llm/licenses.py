"""License scans: Dice coefficient over word bigrams between normalised text and templates.

A document's units are its lines, its paragraphs (runs of lines between empty ones) and the
whole text. A unit's Dice coefficient with a template can reach the threshold t only if its
number of bigrams lies between t / (2 - t) and (2 - t) / t of the template's; templates are
sorted by size, so the candidates of a unit are one slice. Units outside every slice are never
cut into bigrams. For what remains, an index from bigrams to templates counts the shared ones.

Beside the units stand windows over the word sequence of the whole text, so that a template is
found inside a line and across paragraphs. The best windows begin and end at a bigram of the
template, hold at least t / (2 - t) of its bigrams and have a size within the same bounds, so
only such windows are compared. Of overlapping windows of a license the one of the highest
coefficient is a match (then the first, then the longest), unless a unit that overlaps it has
the same license with the same coefficient or a higher one. A match of which most lies in a match
of a license whose template contains its own (BSD-2-Clause in BSD-3-Clause) is a part of that one.

Normalising: lower case, American spelling, no numbers of list items, no copyright lines.

Defined cases: a null or empty text has no match; a very long text is compared whole; a template that matches a line and the
paragraph of just that line counts once; among equal coefficients the first name by alphabet
is the best; rows that repeat are each scanned; a null doc_id stays null; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import prepare

THRESHOLD = 0.8
WORD = re.compile(r"[a-z0-9]+")

# Warranty clauses that several licenses end in.
MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

# Public notices and license texts, by name.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."],
}
# The whole texts of licenses of a few paragraphs: what they grant, then the warranty clause.
for _name, _clause in (("BSD-2-Clause", BSD_WARRANTY), ("BSD-3-Clause", BSD_WARRANTY), ("ISC", ISC_WARRANTY), ("MIT", MIT_WARRANTY)):
    TEMPLATES[_name].append(f"{TEMPLATES[_name][-1]} {_clause}")


#: The number or letter of a list item at the start of a line, and a line's copyright notice; both become spaces.
MARKS = re.compile(r"^[ \t/*#;-]*(?:\(?(?:\d{1,2}|[a-z])[.)](?=\s)|(?:copyright\b|\(c\)|\u00a9)[^\n]{0,200}\d{4}[^\n]{0,200}$)", re.M)


def _normal(text: str) -> str:
    low = text.lower().replace("licence", "license")
    return MARKS.sub(lambda m: " " * len(m.group()), low)


def words(text: str) -> list[str]:
    """Normalised text: lower-case runs of letters a-z and digits, in American spelling, without signs of copyright and numbers of list items."""
    return [m.group() for m in WORD.finditer(_normal(text))]


def bigrams(tokens: list[str]) -> Counter:
    return Counter(zip(tokens, tokens[1:], strict=False))


def _contained(templates: dict[str, list[str]]) -> dict[tuple[str, str], list[tuple[int, int, float]]]:
    """For (a, b) where a template of license a is a part of one of b (but for a bigram in fifty): the lengths of both, and the coefficient from which on a text is b rather than a.

    It lies half-way between the coefficients with b's template of the part alone and of the whole.
    """
    made = [(name, len(t), bigrams(words(t))) for name, texts in templates.items() for t in texts]
    out: dict[tuple[str, str], list[tuple[int, int, float]]] = {}
    for a, m, x in made:
        for b, n, y in made:
            if a != b and x.total() < y.total() and (x & y).total() >= 0.98 * x.total():
                out.setdefault((a, b), []).append((m, n, 0.5 + x.total() / (x.total() + y.total())))
    return out


class Templates:
    """Templates sorted by number of bigrams, with an index of their bigrams."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.contained = _contained(templates)
        made = sorted(((len(words(t)) - 1, name, bigrams(words(t))) for name, texts in templates.items() for t in texts), key=lambda x: x[:2])
        self.sizes = [m[0] for m in made]
        self.names = [m[1] for m in made]
        self.grams = [m[2] for m in made]
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for k, (_, _, grams) in enumerate(made):
            for g, n in grams.items():
                self.index.setdefault(g, []).append((k, n))
        self.ratio = threshold / (2 - threshold)
        self.least = self.sizes[0] * self.ratio
        self.most = self.sizes[-1] / self.ratio

    def best(self, tokens: list[str]) -> dict[str, float]:
        """The coefficient of each license that reaches the threshold."""
        n = len(tokens) - 1
        low, high = bisect_left(self.sizes, n * self.ratio - 1e-9), bisect_right(self.sizes, n / self.ratio + 1e-9)
        if low >= high:
            return {}
        shared: dict[int, int] = {}
        for g, count in bigrams(tokens).items():
            for k, own in self.index.get(g, ()):
                if low <= k < high:
                    shared[k] = shared.get(k, 0) + min(own, count)
        out: dict[str, float] = {}
        for k, s in shared.items():
            dice = 2 * s / (n + self.sizes[k])
            if dice >= self.threshold:
                out[self.names[k]] = max(dice, out.get(self.names[k], 0))
        return out


def units(text: str) -> Iterator[tuple[int, int]]:
    """Places of lines, of paragraphs of two lines or more, and of the whole text if it has several paragraphs."""
    at, start, lines, paragraphs = 0, 0, 0, 0
    for line in text.split("\n"):
        blank = not line.strip()
        if blank and lines:
            paragraphs += 1
            if lines > 1:
                yield start, at - 1
            lines = 0
        elif not blank:
            if not lines:
                start = at
            lines += 1
            yield at, at + len(line)
        at += len(line) + 1
    if lines > 1:
        yield start, len(text)
    if paragraphs + bool(lines) > 1:
        yield 0, len(text)


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of words(text), in the text itself."""
    low = _normal(text)
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    at = [i for i, c in enumerate(text) for _ in c.lower()]  # some letters are two in lower case
    return [(at[m.start()], at[m.end() - 1] + 1) for m in WORD.finditer(low)]


def _chosen(text: str, found: dict[str, list[tuple[float, int, int]]], of_units: list[tuple[int, int, str, float]], contained: dict[tuple[str, str], list[tuple[int, int, float]]]) -> list[tuple[int, int, str, float]]:
    """The matches of units and those of the windows (coefficient, first and last bigram, by license), as places in the text."""
    out = []
    places = _places(text) if found else []
    for name, windows in found.items():
        taken: list[tuple[int, int]] = []
        for dice, i, j in sorted(windows, key=lambda w: (-w[0], w[1], -w[2])):
            start, end = places[i][0], places[j + 1][1]
            if any(start < b and a < end for a, b in taken):
                continue
            taken.append((start, end))
            if not any(start < b and a < end and d >= dice - 1e-9 for a, b, n, d in of_units if n == name):
                out.append((start, end, name, dice))
    out += of_units

    def part(m: tuple[int, int, str, float], o: tuple[int, int, str, float]) -> bool:
        pairs = contained.get((m[2], o[2]))
        if not pairs or 2 * (min(m[1], o[1]) - max(m[0], o[0])) <= m[1] - m[0]:
            return False
        return o[3] >= min(pairs, key=lambda c: abs(c[0] - m[1] + m[0]) + abs(c[1] - o[1] + o[0]))[2]  # the templates of the nearest lengths

    return sorted(m for m in out if not any(part(m, o) for o in out))


def windows(tokens: list[str], templates: Templates) -> dict[str, list[tuple[float, int, int]]]:
    """For each license, the windows that reach the threshold: coefficient, first and last bigram."""
    pairs = list(zip(tokens, tokens[1:], strict=False))
    at: dict[int, list[int]] = {}
    for p, g in enumerate(pairs):
        for k, _ in templates.index.get(g, ()):
            at.setdefault(k, []).append(p)
    out: dict[str, list[tuple[float, int, int]]] = {}
    for k, where in at.items():
        size, own = templates.sizes[k], templates.grams[k]
        least, most = size * templates.ratio - 1e-9, size / templates.ratio + 1e-9
        last = 0
        for first, i in enumerate(where):
            while last < len(where) and where[last] - i + 1 <= most:
                last += 1
            if last - first < least:
                continue
            seen: dict[tuple[str, str], int] = {}
            shared = 0
            for j in where[first:last]:
                g = pairs[j]
                n = seen[g] = seen.get(g, 0) + 1
                shared += n <= own[g]
                dice = 2 * shared / (j - i + 1 + size)
                if dice >= templates.threshold:
                    out.setdefault(templates.names[k], []).append((dice, i, j))
    return out


def matches(text: str, templates: Templates) -> list[tuple[int, int, str, float]]:
    """(start, end, license, coefficient) of all units and windows that match."""
    out = []
    for start, end in units(text):
        # a word takes two characters at least with what parts it; most units are too short or too long
        if end - start < 2 * templates.least:
            continue
        tokens = words(text[start:end])
        if templates.least - 1e-9 <= len(tokens) - 1 <= templates.most + 1e-9:
            out += [(start, end, name, dice) for name, dice in templates.best(tokens).items()]
    return _chosen(text, windows(words(text), templates), out, templates.contained)


def _scanned(texts: dict[str, list[str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, threshold)
        for batch in batches:
            found = [matches(t.as_py() or "", templates) for t in batch.column(1)]
            best = [min(((-m[3], m[2]) for m in f), default=(0.0, None)) for f in found]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_matches": pa.array([len(f) for f in found], pa.int64()),
                "license": pa.array([b[1] for b in best], pa.string()), "dice": pa.array([round(abs(b[0]), 6) for b in best], pa.float64()),
                "spans": pa.array([",".join(f"{m[2]}:{m[0]}:{m[1]}" for m in f) for f in found], pa.string()),
            })

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_matches, the best license with its coefficient, and all spans (name:start:end, code points).

    templates: texts by license name in place of TEMPLATES, such as those of read_templates().
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_scanned(templates or TEMPLATES, threshold), "doc_id long, n_matches long, license string, dice double, spans string")


def read_templates(spark: SparkSession, folder: str, most: int = 2000) -> dict[str, list[str]]:
    """TEMPLATES and the whole texts of a folder, a file each, named by license: for long licenses, which are not kept in this module."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    for r in sorted(rows):
        if len(words(r["value"])) > 1:
            out.setdefault(r["name"], []).append(r["value"])
    return out


def brute_force(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """All units against all templates without bounds, and all windows from every word on, for tests."""
    out = []
    for start, end in units(text):
        best: dict[str, float] = {}
        mine = bigrams(words(text[start:end]))
        for name, texts in TEMPLATES.items():
            for t in texts:
                other = bigrams(words(t))
                total = sum(mine.values()) + sum(other.values())
                dice = 2 * sum((mine & other).values()) / total if total else 0
                if dice >= threshold:
                    best[name] = max(dice, best.get(name, 0))
        out += [(start, end, name, d) for name, d in best.items()]
    tokens = words(text)
    pairs = list(zip(tokens, tokens[1:], strict=False))
    found: dict[str, list[tuple[float, int, int]]] = {}
    for name, texts in TEMPLATES.items():
        for other in map(bigrams, map(words, texts)):
            size = sum(other.values())
            for i in range(len(pairs)):
                left, shared = Counter(other), 0
                for j in range(i, min(len(pairs), i + int(size * (2 - threshold) / threshold) + 2)):
                    shared += left[pairs[j]] > 0
                    left[pairs[j]] -= 1
                    if 2 * shared / (j - i + 1 + size) >= threshold:
                        found.setdefault(name, []).append((2 * shared / (j - i + 1 + size), i, j))
    return _chosen(text, found, out, _contained(TEMPLATES))
