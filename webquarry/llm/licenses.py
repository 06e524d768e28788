"""License scans by patience alignment of texts with license templates.

Words unique to both a stretch of text and a template are anchors; the longest
increasing subsequence of anchors is kept, and the gaps between them are aligned
in the same way, where words may be unique again.  A gap without anchors takes
equal words from either end.  Coverage is the share of a template's words that are
aligned.

Stretches come from the template's telling words (not in COMMON): their places in
the text, joined over gaps of up to a template's length and cut into overlapping
windows of twice that length and windows at the first telling word, so a license
that occurs twice is found twice, and a long text costs time in proportion to its
length.  A stretch that lacks more of a template's telling words (counted at most as
often as the template has them) than the coverage asked for lets it miss is not
aligned, as it cannot match.  A template of fewer than ``short`` words matches word
for word only: in so short a notice the words in which licenses differ are within
what the coverage would let it miss.  The usual one-line notices are such templates,
made by rule from ways to begin and names of licenses, so their words must all be there.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.
Null and empty texts have no license.  Where several templates overlap, the one
with more aligned words wins, then higher coverage, then the smaller name.
Positions are words, ends exclusive.  All input columns stay; the result columns
replace clashing ones.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.udf import text_udf, with_struct

#: Words that alone do not point to a license.
COMMON = frozenset("a an and any are as at be by for from in is it may no not of on or that the this to under with you your all work version".split())

#: Templates of fewer words match word for word only.
SHORT = 20

# Fixed texts of public licenses and of their usual notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved.",
}


#: Ways to begin a notice, and names that licenses go by in one; fixed texts.
WAYS = ("licensed under", "released under", "distributed under", "available under", "provided under", "published under", "under the terms of")
NAMES = {
    "MIT": ("MIT License", "MIT Licence"),
    "Apache-2.0": ("Apache License 2.0", "Apache License Version 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"),
    "GPL-2.0": ("GPLv2", "GNU GPLv2", "GPL 2.0", "GPL-2.0", "GNU GPL v2", "GNU General Public License v2", "GNU General Public License version 2"),
    "GPL-3.0": ("GPLv3", "GNU GPLv3", "GPL 3.0", "GPL-3.0", "GNU GPL v3", "GNU General Public License v3", "GNU General Public License version 3"),
    "LGPL-3.0": ("LGPLv3", "GNU LGPLv3", "LGPL 3.0", "GNU Lesser General Public License v3", "GNU Lesser General Public License version 3"),
    "AGPL-3.0": ("AGPLv3", "GNU AGPLv3", "AGPL 3.0", "GNU Affero General Public License v3", "GNU Affero General Public License version 3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License version 2.0", "MPL 2.0", "MPL-2.0"),
    "ISC": ("ISC License", "ISC Licence"),
}


def notices() -> dict[str, str]:
    """One-line notices by rule: every way to begin, with and without "the", before every name, and SPDX identifiers.

    They are named <license>-notice~<number>; matches go by what stands before the "~".
    """
    out = {}
    for license_id, names in NAMES.items():
        texts = [f"{way}{the} {name}" for way in WAYS for the in (" the", "") for name in names] + [f"SPDX-License-Identifier: {license_id}"]
        distinct = {" ".join(words_of(t)): t for t in texts}
        out |= {f"{license_id}-notice~{i}": t for i, t in enumerate(distinct.values())}
    return out


def words_of(text: str) -> list[str]:
    s = scan.Scan(pa.array([text], type=pa.string()), word=scan.ALNUM_LOWER)
    data = s.text.tobytes()
    return [data[a:b].decode() for a, b in zip(s.start, s.end, strict=True)]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles as in patience."""
    tops: list[int] = []
    pile: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(pile[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            pile.append(i)
        else:
            tops[k], pile[k] = v, i
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of aligned places in a and b, ascending in both."""
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
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if r > p + 1 and s > q + 1]
    return sorted(out)


@dataclass
class Template:
    name: str
    words: list[int]
    telling: Counter


@dataclass(frozen=True)
class Match:
    name: str
    first: int
    last: int
    aligned: int
    coverage: float


class Scanner:
    """Templates as word numbers, and their telling words."""

    def __init__(self, templates: dict[str, str], coverage: float, short: int = 0):
        self.coverage = coverage
        self.short = short
        texts = {name: words_of(text) for name, text in sorted(templates.items())}
        vocabulary = sorted({w for words in texts.values() for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.lookup = scan.Lookup(np.array([scan.hash_of(w) for w in vocabulary], dtype=np.uint64))
        # number of a word by its place in the sorted hashes
        self.number = np.zeros(max(len(vocabulary), 1), dtype=np.int64)
        for w, i in number.items():
            self.number[np.searchsorted(self.lookup.keys, np.uint64(scan.hash_of(w)))] = i
        quiet = COMMON | {w for way in WAYS for w in words_of(way)}
        told = lambda n, w: w not in COMMON if "~" not in n else w not in quiet and not w.isdigit()
        self.templates = [Template(n, [number[w] for w in words], Counter(number[w] for w in words if told(n, w))) for n, words in texts.items() if words]
        self.users: dict[int, list[int]] = {}
        for t, template in enumerate(self.templates):
            for w in template.telling:
                self.users.setdefault(w, []).append(t)

    def chunk(self, chunk: pa.Array) -> list[list[Match]]:
        """Matches in each text of a chunk."""
        s = scan.Scan(chunk, word=scan.ALNUM_LOWER)
        at, place = self.lookup.find(s.words())
        numbers = np.full(len(s.start), -1, dtype=np.int64)
        numbers[at] = self.number[place]
        out = []
        for d in range(s.n_docs):
            own = numbers[s.first[d] : s.first[d + 1]]
            known = np.flatnonzero(own >= 0)
            out.append(self.matches(own, known) if len(known) else [])
        return out

    def matches(self, words: np.ndarray, known: np.ndarray) -> list[Match]:
        places: dict[int, list[int]] = {}
        for p in known.tolist():
            for t in self.users.get(int(words[p]), ()):
                places.setdefault(t, []).append(p)
        found = []
        for t, own in places.items():
            template = self.templates[t]
            n = len(template.words)
            if len(own) < self.least(template):
                continue
            group = [own[0]]
            for p in [*own[1:], None]:
                if p is not None and p - group[-1] <= n:
                    group.append(p)
                    continue
                found += self.stretch(words, template, group)
                group = [p]
        found = [replace(m, name=m.name.split("~")[0]) for m in found]
        found.sort(key=lambda m: (-m.aligned, -m.coverage, m.name, m.first))
        chosen: list[Match] = []
        for m in found:
            if all(m.last <= c.first or m.first >= c.last for c in chosen):
                chosen.append(m)
        return sorted(chosen, key=lambda m: m.first)

    def least(self, template: Template) -> int:
        """Telling words that a stretch of the coverage asked for must hold: all but the words it may miss."""
        missed = len(template.words) - self.needed(template)
        return max(1, sum(template.telling.values()) - missed)

    def needed(self, template: Template) -> int:
        """Words that must be aligned."""
        n = len(template.words)
        return n if n < self.short else math.ceil(self.coverage * n)

    def stretch(self, words: np.ndarray, template: Template, places: list[int]) -> list[Match]:
        n = len(template.words)
        lo, hi = max(0, places[0] - n), min(len(words), places[-1] + 1 + n)
        # windows of twice the template's length, half over each other; and, as repeats leave no
        # word unique, windows that begin where the template would by its first telling word
        lead = next(i for i, w in enumerate(template.words) if w in template.telling)
        spans = {(a, min(hi, a + 2 * n)) for a in range(lo, max(lo + 1, hi - n), n)} | ({(lo, hi)} if hi - lo <= 3 * n else set())
        spans |= {(max(0, p - lead), min(len(words), p - lead + n + n // 2)) for p in places if words[p] == template.words[lead]}
        out = []
        for a, b in sorted(spans):
            part = words[a:b].tolist()
            have = Counter(w for w in part if w in template.telling)
            if sum(min(k, template.telling[w]) for w, k in have.items()) < self.least(template):
                continue
            pairs = align(part, template.words)
            if len(pairs) < self.needed(template):
                continue
            if n >= self.short or pairs[-1][0] - pairs[0][0] + 1 == n:
                out.append(Match(template.name, a + pairs[0][0], a + pairs[-1][0] + 1, len(pairs), len(pairs) / n))
        return out


#: Least coverage of a template that counts as a match.
COVERAGE = 0.8


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, short: int = SHORT, text_col: str = "text") -> DataFrame:
    """df plus licenses: array of (name, first, last, coverage) in order of place."""
    scanner = Scanner(TEMPLATES | notices() if templates is None else templates, coverage, short)
    sent = df.sparkSession.sparkContext.broadcast(scanner)

    def start():
        ready = sent.value
        return lambda chunk: {"licenses": [[{"name": m.name, "first": m.first, "last": m.last, "coverage": m.coverage} for m in found] for found in ready.chunk(chunk)]}

    return with_struct(df, text_udf("licenses array<struct<name: string, first: int, last: int, coverage: double>>", start)(F.col(f"`{text_col}`").cast("string")), ["licenses"])


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, n_licenses, licenses (names, comma-joined in order of place), best_coverage (0 without one)."""
    found = scan_licenses(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")), **options)
    return found.select(id_col, F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["name"]), ",").alias("licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"))
