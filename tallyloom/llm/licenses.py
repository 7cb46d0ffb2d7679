"""License scans by patience alignment.

A template and a stretch of text are anchored on words that are unique to
both, of which the longest increasing subsequence is kept; the gaps between
anchors are aligned the same way. Coverage is the share of the template's words
that are matched. Stretches are twice the template's length and begin at every
multiple of it, so one holds each occurrence whole; only stretches that hold
enough of a template's words are aligned, as others can't reach the threshold.

In a short template a few words tell one license from another, so it has to be
matched whole, and a longer one has to be matched in its telling words (names
and versions). All matches are returned; the one of most words comes first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .decontaminate import words_of

#: Short notices that are common, and the notices and texts of licenses in their own words, without the numbers of list items.
TEMPLATES = {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 short": "Licensed under CC BY-SA 4.0.",
    "ISC full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD name": "Released under the BSD License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 full": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 name": "GNU General Public License, version 2.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0 text": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 name": "GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 text": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: The names by which licenses are mentioned, as words.
NAMES = {
    "AGPL-3.0": ("agplv3", "agpl v3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later", "gnu affero general public license"),
    "Apache-2.0": ("apache license", "apache licence", "apache license version 2 0", "apache 2 0", "apache license 2 0", "apache 2 0 license"),
    "BSD": ("bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "bsd 2 clause license", "bsd 3 clause license"),
    "CC-BY-3.0": ("cc by 3 0",), "CC-BY-4.0": ("cc by 4 0",), "CC-BY-NC-4.0": ("cc by nc 4 0",), "CC-BY-SA-4.0": ("cc by sa 4 0",),
    "GPL-2.0": ("gplv2", "gpl v2", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gnu general public license version 2", "gnu general public license v2"),
    "GPL-3.0": ("gplv3", "gpl v3", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later", "gnu general public license version 3", "gnu general public license v3"),
    "ISC": ("isc", "isc license"),
    "LGPL-2.1": ("lgplv2 1", "lgpl v2 1", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later", "gnu lesser general public license version 2 1"),
    "LGPL-3.0": ("lgplv3", "lgpl v3", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later", "gnu lesser general public license version 3"),
    "MIT": ("mit", "mit license", "mit licence"),
    "MPL-2.0": ("mpl 2 0", "mozilla public license", "mozilla public license 2 0", "mozilla public license version 2 0"),
    "Unlicense": ("unlicense", "the unlicense"),
}
#: Words before a name that make it a mention: grants, and the tag of a machine-readable notice.
GRANTS = ("under", "under the", "under a", "under an", "under the terms of the", "spdx license identifier")
NEGATIONS = frozenset(b"not never isn aren wasn cannot neither nor".split())

#: Templates of at most so many words are matched whole.
SHORT = 16
#: Words that tell licenses apart, besides numbers.
TELLING = frozenset(b"apache bsd mit mozilla mpl gnu gpl lesser affero lgpl agpl cc by nc nd sa creative commons attribution noncommercial noderivatives sharealike copyleft".split())

#: Those of them that make another license of a long notice, too.
MODIFIERS = frozenset(b"lesser affero nc nd sa noncommercial noderivatives sharealike".split())


def negated(words: list[bytes], first: int) -> bool:
    """Whether one of the three words before says no."""
    return any(w in NEGATIONS for w in words[max(0, first - 3) : first])


_PHRASES: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = {}
for _license, _names in NAMES.items():
    for _name in _names:
        _words = tuple(_name.encode().split())
        _PHRASES.setdefault(_words[0], []).append((_words, _license))
_GRANTS = sorted((tuple(g.encode().split()) for g in GRANTS), key=len, reverse=True)


def mentions(words: list[bytes]) -> list[tuple[str, int, int, bool]]:
    """(license, first and last word, negated) of every name of a license that follows a grant, the longest name at each place."""
    out, free = [], 0
    for i in np.flatnonzero(np.fromiter(map(_PHRASES.__contains__, words), bool, len(words))).tolist():
        fits = [(len(p), name) for p, name in _PHRASES[words[i]] if tuple(words[i : i + len(p)]) == p]
        grant = next((len(g) for g in _GRANTS if tuple(words[max(0, i - len(g)) : i]) == g), 0)
        if fits and grant and i >= free:
            size, name = max(fits)
            out.append((name, i - grant, i + size - 1, negated(words, i - grant) or words[i - grant - 1 : i - grant] == [b"licensed"] and negated(words, i - grant - 1)))
            free = i + size
    return out


def telling(word: bytes) -> bool:
    return word in TELLING or word.isdigit()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first numbers, a longest run whose second ones increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both, by patience: equal ends, unique common words, then the gaps."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a = {w for w, n in Counter(a[i:j]).items() if n == 1}
        once_b = {w: y for y, w in enumerate(b[k:m], k)}
        twice_b = {w for w, n in Counter(b[k:m]).items() if n > 1}
        anchors = _increasing([(x, once_b[w]) for x, w in enumerate(a[i:j], i) if w in once_a and w in once_b and w not in twice_b])
        if not anchors:
            continue
        out += anchors
        last = (i - 1, k - 1)
        for x, y in [*anchors, (j, m)]:
            todo.append((last[0] + 1, x, last[1] + 1, y))
            last = (x, y)
    return sorted(out)


def _whole(words: list[bytes], begin: int, pairs: list[tuple[int, int]], t: list[bytes]) -> bool:
    """Whether a match misses none of the words that it must have, and none that makes another license stands within it."""
    met, taken = {y for _, y in pairs}, {x for x, _ in pairs}
    extra = {words[begin + x] for x in range(pairs[0][0], pairs[-1][0]) if x not in taken}
    if len(t) <= SHORT:
        return len(met) == len(t) and not any(map(telling, extra))
    return not any(telling(w) and w != b"by" and y not in met for y, w in enumerate(t)) and not extra & MODIFIERS


def matches(words: list[bytes], templates: list[tuple[str, list[bytes]]], threshold: float) -> list[tuple[str, int, float, int, int]]:
    """(name, matched words, coverage, first and last place in the text) of every occurrence of a template whose coverage is
    the threshold or more, most matched words first; of equals the one of higher coverage, then the earlier place, then the
    earlier name. Of matches that lie within each other only the first stays."""
    vocabulary = {w for _, t in templates for w in t}
    held = {name: Counter(t) for name, t in templates}
    at = np.flatnonzero(np.fromiter(map(vocabulary.__contains__, words), bool, len(words))).tolist()
    found: set[tuple] = set()
    for name, t in templates:
        own, size = set(t), len(t)
        here = [p for p in at if words[p] in own]
        need = threshold * size
        if len(here) < need:
            continue
        blocks = Counter(p // size for p in here)
        for block in blocks.keys() | {b - 1 for b in blocks if b}:
            if blocks[block] + blocks[block + 1] < need:
                continue
            top = (block * size, min(len(words), (block + 2) * size))
            begins = [p for p in range(*top) if words[p] == t[0]]
            # words of several notices may have been matched: then each begins with the template's first word
            todo = [*((p, end) for p, after in zip(begins, [*begins[1:], top[1]]) for end in {after, min(top[1], p + size + size // 4)}), top]
            while todo:
                begin, end = todo.pop()
                if bisect_left(here, end) - bisect_left(here, begin) < need:
                    continue
                if size > SHORT and (Counter(words[begin:end]) & held[name]).total() < need or len(pairs := align(words[begin:end], t)) < need:
                    continue
                first, last = begin + pairs[0][0], begin + pairs[-1][0]
                if _whole(words, begin, pairs, t) and not (size <= SHORT and negated(words, first)):
                    found.add((-len(pairs), -len(pairs) / size, first, name, last))
                    # what is left on either side of a match may hold another
                    todo += [(begin, first), (last + 1, end)]
    out: list[tuple] = []
    for m in sorted(found):
        if not any(k[2] <= m[2] and m[4] <= k[4] or k[3] == m[3] and k[2] <= m[4] and m[2] <= k[4] for k in out):
            out.append(m)
    return [(name, -n, -coverage, first, last) for n, coverage, first, name, last in out]


MATCH = pa.schema([("license", pa.string()), ("n_matched", pa.int64()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
MATCH_DDL = "license string, n_matched long, coverage double, first_word long, last_word long"

MENTION = pa.schema([("license", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("negated", pa.bool_())])
MENTION_DDL = "license string, first_word long, last_word long, negated boolean"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, license (null if no template reaches the threshold), n_matched, coverage,
    first_word and last_word of the match of most words, and matches, all of them in that order. mentions has the names of licenses
    that follow a grant ("under the MIT License") or the tag of a machine-readable notice, which are a kind of their own and
    make no match: license, first and last word, and whether one of the three words before says no. A short
    notice with such a word before it ("not licensed under ...") is no match.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased; whole texts are scanned. Null and empty texts match nothing;
    templates without words are left out. Each row of a repeated id counts by
    itself. Other columns are left out.
    """
    known = [(name, w) for name, t in sorted((TEMPLATES if templates is None else templates).items()) if (w := words_of(t))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            out = []
            for value in part.column("x").to_pylist():
                words = words_of(value)
                found = matches(words, known, threshold)
                out.append((len(words), *(found[0] if found else (None, 0, 0.0, None, None)), [dict(zip(MATCH.names, m)) for m in found], [dict(zip(MENTION.names, m)) for m in mentions(words)]))
            n, name, matched, coverage, first, last, every, named = map(list, zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(matched, pa.int64()), pa.array(coverage, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(every, pa.list_(pa.struct(list(MATCH)))), pa.array(named, pa.list_(pa.struct(list(MENTION))))],
                names=["doc_id", "n_words", *MATCH.names, "matches", "mentions"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x"))
    return picked.mapInArrow(rows, f"doc_id long, n_words long, {MATCH_DDL}, matches array<struct<{MATCH_DDL}>>, mentions array<struct<{MENTION_DDL}>>")
