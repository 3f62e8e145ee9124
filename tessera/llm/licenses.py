"""License scans by patience alignment of texts with license templates.

A template and a stretch of text are anchored on the words that occur once in both; the longest increasing subsequence of
the anchors is kept, and the gaps between them are aligned in the same way. Where a gap has no such word, its common
beginning and end are matched, and the rest by its longest common subsequence. Coverage is the share of the template's
words that are matched. Between neighbouring copies no word is unique in a wide stretch; so stretches of about the
template's length around each seed are aligned too, each cut to where its longest common subsequence lies.
Stretches that overlap a match are aligned again without it, until nothing more is found.

A bound of the operator: a match is sought within the template's length and a quarter of it around a seed, so a template whose
words stand apart by more foreign words than that (one beside every word is found, two are not) has no match."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, per_text

# License notices, openings and whole texts as their publishers word them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
}
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Up to this many pairs of words a gap without a unique word is aligned cell by cell, beyond it by bit rows.
SMALL = 4096


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct values, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two short stretches."""
    n, m = a1 - a0, b1 - b0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[a0 + i] == b[b0 + j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def masks_of(words: list[str]) -> dict[str, int]:
    """By word, its places as bits."""
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def bit_rows(masks: dict[str, int], n: int, words: Iterable[str]) -> Iterator[int]:
    """After each word, a row of n bits: the zeros among its lowest k are the length of the longest common subsequence of the words so far with the first k of the masks."""
    full = row = (1 << n) - 1
    for w in words:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
        yield row


def long_common(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two stretches, a bit for each pair of words."""
    rows = [*bit_rows(masks_of(a[a0:a1]), a1 - a0, b[b0:b1])]
    out, i, j = [], a1 - a0, b1 - b0
    while i and j:
        if rows[j - 1] >> i - 1 & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> i - 1 & 1:
                i -= 1
                out.append((a0 + i, b0 + j))
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
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
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in where]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            out += (common if (a1 - a0) * (b1 - b0) <= SMALL else long_common)(a, b, a0, a1, b0, b1)
            continue
        for (i, j), (x, y) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            todo.append((i + 1, x, j + 1, y))
        out += kept
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, words_of(text)
        counts = Counter(self.words)
        self.spare = len(self.words) - -(-len(self.words) * least // 1)
        # Longest words first: they are the least likely to be met by chance.
        self.tests = sorted(counts.items(), key=lambda x: (-len(x[0]), x[0]))
        self.seeds, n = [], 0
        for w, k in self.tests:
            self.seeds.append(w)
            n += k
            if n > self.spare:
                break
        self.places = {w: [i for i, x in enumerate(self.words) if x == w] for w in self.seeds}
        self.masks, self.back = masks_of(self.words), masks_of(self.words[::-1])

    def possible(self, present: set[str]) -> bool:
        """False only if so many of the words are absent that the coverage can't be reached."""
        missing = 0
        for w, k in self.tests:
            if w not in present:
                missing += k
                if missing > self.spare:
                    return False
        return True

    def spots(self, words: list[str], slack: int) -> list[int]:
        """Places of seeds around which so many of the template's words stand that the coverage can be reached, by a sliding count."""
        n, want, have, held = len(self.words), dict(self.tests), Counter(), 0
        out, lo, hi = [], 0, 0
        for p, w in enumerate(words):
            if w not in self.places:
                continue
            while hi < min(len(words), p + n + slack):
                x = words[hi]
                hi += 1
                if x in want:
                    have[x] += 1
                    held += have[x] <= want[x]
            while lo < p - n - slack:
                x = words[lo]
                lo += 1
                if x in want:
                    held -= have[x] <= want[x]
                    have[x] -= 1
            if n - held <= self.spare:
                out.append(p)
        return out

    def tight(self, words: list[str], lo: int, hi: int, least: float) -> tuple[int, int] | None:
        """The stretch within words[lo:hi] that holds its longest common subsequence with the template: the first to end, from its last beginning. None if that is shorter than least asks."""
        n = len(self.words)
        lengths = [n - row.bit_count() for row in bit_rows(self.masks, n, words[lo:hi])]
        best = max(lengths, default=0)
        if not best or best / n < least:
            return None
        hi = lo + lengths.index(best) + 1
        for k, row in enumerate(bit_rows(self.back, n, reversed(words[lo:hi])), 1):
            if n - row.bit_count() == best:
                return hi - k, hi
        return None

    def match(self, words: list[str], lo: int, hi: int) -> tuple[float, int, int]:
        pairs = align(self.words, words[lo:hi])
        while pairs and pairs[-1][1] - pairs[0][1] > 2 * len(self.words) + 4:  # a stray word far off
            left, right = pairs[1][1] - pairs[0][1] if len(pairs) > 1 else 0, pairs[-1][1] - pairs[-2][1] if len(pairs) > 1 else 0
            pairs = pairs[1:] if left >= right else pairs[:-1]
        return (len(pairs) / len(self.words), lo + pairs[0][1], lo + pairs[-1][1] + 1) if pairs else (0.0, lo, lo)

    def find(self, words: list[str], least: float) -> list[tuple[float, int, int]]:
        """(coverage, first word, one past the last) of the non-overlapping matches, the best first. A match that reaches least holds one of the seeds."""
        n, slack = len(self.words), len(self.words) // 4 + 2
        spots = [(p, 0, len(words)) for p in self.spots(words, slack)]
        known: dict[tuple[int, int, bool], list[tuple[float, int, int]]] = {}
        out: list[tuple[float, int, int]] = []

        def tried(lo: int, hi: int, wide: bool) -> list[tuple[float, int, int]]:
            if (lo, hi, wide) not in known:
                inner = self.tight(words, lo, hi, least)
                known[lo, hi, wide] = [self.match(words, *x) for x in ([inner, (lo, hi)] if wide else [inner])] if inner else []
            return known[lo, hi, wide]

        while spots:
            found: dict[tuple[int, int], float] = {}
            for p, low, high in spots:
                stretches = {(max(low, p - q - slack), min(high, p - q + n + slack), False) for q in self.places[words[p]]}
                stretches.add((max(low, p - n - slack), min(high, p + n + slack), True))
                for stretch in stretches:
                    for cover, a, b in tried(*stretch):
                        if cover >= least:
                            found[a, b] = max(found.get((a, b), 0.0), cover)
            taken: list[tuple[float, int, int]] = []
            starts: list[int] = []
            for (a, b), cover in sorted(undivided(found).items(), key=lambda x: (-x[1], x[0][1] - x[0][0], x[0])):
                k = bisect_left(starts, a)
                if (not k or taken[k - 1][2] <= a) and (k == len(starts) or b <= starts[k]):
                    starts.insert(k, a)
                    taken.insert(k, (cover, a, b))
            if not taken:
                break
            out += taken
            left = []
            for p, low, high in spots:
                k = bisect_left(starts, p + 1)
                if not k or taken[k - 1][2] <= p:
                    left.append((p, max(low, taken[k - 1][2]) if k else low, min(high, starts[k]) if k < len(starts) else high))
            spots = left
        return sorted(out, key=lambda x: (-x[0], x[1]))


def undivided(found: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """The matches without those that hold two others that don't overlap: they took their words from two copies."""
    by_start, by_end = sorted(found), sorted(found, key=lambda x: x[1])
    first_end = [*accumulate((b for _, b in reversed(by_start)), min)][::-1]
    last_start = [*accumulate((a for a, _ in by_end), max)]
    starts, ends = [a for a, _ in by_start], [b for _, b in by_end]
    return {(a, b): cover for (a, b), cover in found.items() if first_end[bisect_left(starts, a)] > last_start[bisect_right(ends, b) - 1]}


def scan(text: str, templates: list[Template], least: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first character, one past the last) of all matches, by place."""
    low = text.lower()
    present = set(WORD.findall(low))
    wanted = [t for t in templates if t.possible(present)]
    if not wanted:
        return []
    if len(low) != len(text):  # some letters change their length; places are then counted in the lower-case text
        text = low
    places = list(WORD.finditer(low))
    words = [m[0] for m in places]
    found = [(t.name, c, places[a].start(), places[b - 1].end()) for t in wanted for c, a, b in t.find(words, least)]
    return sorted(found, key=lambda x: (x[2], x[0]))


def with_licenses(df: DataFrame, least: float = 0.8, templates: dict[str, str] | None = None, text: str = "text", out: str = "licenses") -> DataFrame:
    """df with an array of matches (license, coverage, start and end in characters) of each whole text.

    Null and empty texts have none; repeated notices are all listed, in a text of any length. Repeated rows are scanned each,
    an own column of the result's name gives way, and an empty table gives no rows."""

    def make():
        known = [Template(n, t, least) for n, t in (templates or TEMPLATES).items()]
        return lambda t: ([*scan(t, known, least)],)

    return appended(df, per_text(make, f"{out} array<struct<license:string,coverage:double,start:long,end:long>>", [out])(F.col(text)), [out])
