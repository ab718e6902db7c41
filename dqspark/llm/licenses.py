"""License scan: coverage of known notices by patience alignment.

Words that occur once in the text and once in the notice are anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned the same way, where
more words have become unique. A notice is found where at least ``COVERAGE`` of its words align.

Only windows that can reach that coverage are aligned: a hit must hold a word of any set of
words that makes up more than 1 - COVERAGE of the notice, so the places of the rarest such set in
the text give all windows. Texts that hold no such word are passed over by a plain search.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dqspark.llm.common import longs, map_batches, texts

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
    " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution.")
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
    " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR"
    " PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,"
    " INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
    " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT"
    " OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING"
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
    " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE.")


def _gnu(which: str, version: str, program: str = "program") -> str:
    """The notice that files under a license of this family carry."""
    return (
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {which} as"
        f" published by the Free Software Foundation, either version {version} of the License, or (at your option) any later"
        f" version. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        f" implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {which} for more details.")


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

#: Fixed texts: whole licenses where they are short, the notices that files carry, and one-line statements.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
        " specific language governing permissions and limitations under the License."],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _NO_WARRANTY],
    "BSD": ["Licensed under the BSD License"],
    "BSD-2-Clause": [f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": [_BSD_NAMES, f"{_BSD} {_BSD_NAMES} {_BSD_END}"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted. " + _ISC_END],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software"
        " for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the"
        " following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote"
        " the original software. If you use this software in a product, an acknowledgment in the product documentation would"
        " be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be"
        " misrepresented as being the original software. This notice may not be removed or altered from any source"
        " distribution."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
        " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", _gnu(_GPL, "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", _gnu(_GPL, "3")],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1", _gnu(_LGPL, "2.1", "library")],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", _gnu(_LGPL, "3")],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", _gnu(_AGPL, "3")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at"],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Licensed under CC0 1.0", "released under the CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0",
                     "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0",
                     "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0",
                     "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0",
                        "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0",
                        "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "all rights reserved": ["All rights reserved"],
}
#: Names by which a machine-readable line gives a license, where they differ from ours.
_IDENTIFIERS = {"GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"),
                "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1-or-later"), "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later"),
                "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later")}
for _name, _texts in NOTICES.items():
    if " " not in _name and _name != "BSD":
        _texts += [f"SPDX-License-Identifier: {x}" for x in (_name, *_IDENTIFIERS.get(_name, ()))]
#: Words without which a notice is another license's: they must be among the aligned ones.
TELLING = re.compile(r"\d+(\.\d+)*$|^(apache|mit|bsd|isc|gnu|lesser|affero|mozilla|eclipse|neither|endorse|cc0?|by|by-.*|"
                     r"attribution.*)$")
#: As short a notice as this also needs these.
SHORT, SHORT_TELLING = 16, re.compile(r"^(public|reserved|rights|all)$|^.*-\d.*$|^(unlicense|zlib|0bsd|isc|mit)$")
#: Words of license names: one that a text adds inside a notice makes it another license's.
NAMES = re.compile(r"^(apache|mit|bsd|gnu|lesser|affero|library|mozilla|eclipse|cc0?|by-.*|attribution.*|noncommercial|"
                   r"sharealike|noderivatives)$")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their spans in code points."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (a, b), sorted by a, with rising b."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {w: j for j, w in enumerate(b[blo:bhi], blo) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = _rising([(i, place[w]) for i, w in enumerate(a[alo:ahi], alo) if w in place])
        if not anchors:
            continue
        out += anchors
        ends = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


@dataclass
class Notice:
    license: str
    text: str
    words: list[str] = field(init=False)
    telling: frozenset[int] = field(init=False)

    def __post_init__(self):
        self.words = words_of(self.text)[0]
        short = len(self.words) <= SHORT
        self.telling = frozenset(j for j, w in enumerate(self.words)
                                 if TELLING.search(w) and (short or w != "by") or short and SHORT_TELLING.search(w))

    def must(self, rank) -> list[str]:
        """Words, by rising ``rank``, that make up more of the notice than a hit may miss."""
        need, out = int(len(self.words) - COVERAGE * len(self.words)) + 1, []
        counts = Counter(self.words)
        for w in sorted(counts, key=rank):
            out.append(w)
            need -= counts[w]
            if need <= 0:
                break
        return out


@cache
def notices() -> tuple[list[Notice], list[str]]:
    """All notices, and words of which every hit holds one."""
    every = [Notice(name, t) for name, some in NOTICES.items() for t in some]
    return every, sorted({w for n in every for w in n.must(lambda w: (-len(w), w))})


def scan(text: str) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of every notice in a text, in order of place."""
    every, signs = notices()
    lower = text.lower()
    if not any(s in lower for s in signs):
        return []
    words, spans = words_of(text)
    places: dict[str, list[int]] = {}
    known = {w for n in every for w in n.words}
    for i, w in enumerate(words):
        if w in known:
            places.setdefault(w, []).append(i)
    hits = []
    for n in every:
        size = len(n.words)
        if sum(w in places for w in n.words) < COVERAGE * size:
            continue
        slack, done = size // 4 + 1, set()
        for w in n.must(lambda w: (len(places.get(w, ())), w)):
            for k in [k for k, x in enumerate(n.words) if x == w]:
                for p in places.get(w, ()):
                    lo = max(0, p - k - slack)
                    if lo in done:
                        continue
                    done.add(lo)
                    if hit := _aligned(n, words, spans, lo, p - k + size + slack):
                        hits.append(hit)
    return _best(hits)


def _aligned(n: Notice, words: list[str], spans: list[tuple[int, int]], lo: int, hi: int):
    """The hit of a notice in a window of words, with the number of aligned words first; or None.

    A word of a license name that the window adds to the notice speaks against it.
    """
    pairs = align(words[lo:hi], n.words)
    if len(pairs) < COVERAGE * len(n.words) or not n.telling <= {j for _, j in pairs}:
        return None
    first, last = lo + pairs[0][0], lo + pairs[-1][0]
    own = {lo + i for i, _ in pairs}
    if any(NAMES.search(words[i]) for i in range(first, last + 1) if i not in own):
        return None
    return len(pairs), n.license, len(pairs) / len(n.words), spans[first][0], spans[last][1]


def _best(hits: list[tuple[int, str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of overlapping hits the one with most aligned words, then most coverage, then the shortest span,
    then the first."""
    out: list[tuple[str, float, int, int]] = []
    for h in sorted(hits, key=lambda h: (-h[0], -h[2], h[4] - h[3], h[3], h[1])):
        h = h[1:]
        at = bisect_left(out, h[2], key=lambda o: o[3] - 1)     # disjoint, in order of place
        if at == len(out) or out[at][2] >= h[3]:
            out.insert(at, h)
    return out


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_hits``, the best hit (``license, coverage,
    start_char, end_char``, null without one), and all ``licenses`` found, each once, sorted.

    A null or empty text has no hit. Ties go to the longer,
    then the earlier hit. Repeated rows
    are scanned alike; an empty table stays empty; texts are scanned whole.
    """
    def make():
        def work(batch):
            found = [scan(t) for t in texts(batch)]
            best = [max(h, key=lambda x: (x[1], x[3] - x[2], -x[2])) if h else (None,) * 4 for h in found]
            return {"doc_id": batch.column("doc_id"), "n_hits": longs([len(h) for h in found]),
                    "license": pa.array([b[0] for b in best], pa.string()),
                    "coverage": pa.array([b[1] for b in best], pa.float64()),
                    "start_char": longs([b[2] for b in best]), "end_char": longs([b[3] for b in best]),
                    "licenses": pa.array([sorted({x[0] for x in h}) for h in found],
                                         pa.list_(pa.string()))}
        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    return map_batches(slim, make, "doc_id long, n_hits long, license string, coverage double, "
                                   "start_char long, end_char long, licenses array<string>")
