"""License texts found by MinHash over overlapping windows."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_rows

SHINGLE = 5
CONTAINED = 0.8
#: Bands of one row each. A text that holds 0.8 of a template's shingles holds a band's own shingle with that chance,
#: so all eight are absent with 0.2 ** 8 or 1 in 390,000 if losses are independent.
BANDS = 8
REMEMBERED = 200_000

_WARRANTY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {what} is free software{where} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."

#: License texts, opening passages, notices and identifiers, as their publishers word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": _GNU.format(what="program", where=";", kind="", n="2"),
    "gpl-3.0": _GNU.format(what="program", where=":", kind="", n="3"),
    "lgpl-2.1": _GNU.format(what="library", where=";", kind="Lesser", n="2.1"),
    "lgpl-3.0": _GNU.format(what="library", where=":", kind="Lesser", n="3"),
    "agpl-3.0": _GNU.format(what="program", where=":", kind="Affero", n="3"),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-notice-2": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice-2": "Licensed under CC BY 4.0.",
    "cc0-1.0-notice": "Public domain CC0 1.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. " + _WARRANTY,
    "mit-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
} | {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-or-later LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 Zlib BSL-1.0".split()}

_EDGES = "\"'`.,;:!?()[]{}<>*-_/\\|#“”‘’"
_GAP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALTS = [np.uint64(xxhash.xxh64_intdigest(f"band {k}".encode()) | 1) for k in range(BANDS)]


class _Words(dict):
    def __missing__(self, word: str) -> int:
        made = xxhash.xxh64_intdigest(normal(word).encode())
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = made
        return made


def normal(word: str) -> str:
    """Lower case, without punctuation at its ends (a word of nothing else stays)."""
    return word.lower().strip(_EDGES) or word.lower()


_WORDS = _Words()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), "u8", len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    out = np.zeros(max(0, n), "u8")
    with np.errstate(over="ignore"):
        for k in range(SHINGLE if n > 0 else 0):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return out


def band_values(shingles: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (shingles ^ (shingles >> np.uint64(32))) * _SALTS[band]
        return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Template:
    name: str
    words: np.ndarray
    shingles: np.ndarray

    @property
    def span(self) -> int:
        """Shingles of a window as long as the template."""
        return len(self.words) - SHINGLE + 1


class Library:
    """Templates and the band values that retrieve them.

    Texts are cut into overlapping windows as long as a template, beginning at each
    eighth of its length, and a text's last window; a shorter text is one window. A
    template is retrieved where a band's minimum over a window is the template's own. A
    window's minimum can only be that where the value itself stands, so minima are
    looked at around these places alone, which costs the same however many templates
    and lengths there are. Templates of fewer words than a shingle are found word by word.
    """

    FILTER = 1 << 18

    def __init__(self, texts: dict[str, str]):
        self.templates, self.short = [], []
        for name, text in sorted(texts.items()):
            words = word_hashes(text.split())
            if not len(words):
                raise ValueError(f"template {name} has no word")
            (self.templates if len(words) >= SHINGLE else self.short).append(Template(name, words, np.unique(shingle_hashes(words))))
        self.owners: list[dict[int, list[int]]] = [{} for _ in range(BANDS)]
        for k, t in enumerate(self.templates):
            for b in range(BANDS):
                self.owners[b].setdefault(int(band_values(t.shingles, b).min()), []).append(k)
        self.may_own = np.zeros((BANDS, self.FILTER), bool)
        for b, owners in enumerate(self.owners):
            for value in owners:
                self.may_own[b, value & (self.FILTER - 1)] = True
        self.first_words = np.array([t.words[0] for t in self.short], "u8")

    def scan(self, docs: list[np.ndarray]) -> list[list[tuple[str, int, int]]]:
        """Matches of each document's word hashes: template, first word, one past the last."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        lengths = [max(0, len(d) - SHINGLE + 1) for d in docs]
        begins = np.concatenate([[0], np.cumsum(lengths)]).astype("i8")
        shingles = np.concatenate([shingle_hashes(d) for d in docs]) if docs else np.zeros(0, "u8")
        for b in range(BANDS):
            hashed = band_values(shingles, b)
            for i in np.flatnonzero(self.may_own[b][hashed & np.uint64(self.FILTER - 1)]).tolist():
                for k in self.owners[b].get(int(hashed[i]), ()):
                    d = int(np.searchsorted(begins, i, "right")) - 1
                    self._retrieve(k, i, hashed, shingles, int(begins[d]), int(begins[d + 1]), found[d])
        out = []
        for doc, matches in zip(docs, found, strict=True):
            rows = [(self.templates[k].name, s, e) for k, s, e in matches]
            if len(self.short) and len(doc):
                for at in np.flatnonzero(np.isin(doc, self.first_words)).tolist():
                    rows += [(t.name, at, at + len(t.words)) for t in self.short if len(doc) >= at + len(t.words) and (doc[at : at + len(t.words)] == t.words).all()]
            out.append(sorted(rows))
        return out

    def _retrieve(self, k: int, i: int, hashed: np.ndarray, shingles: np.ndarray, low: int, high: int, found: list[tuple[int, int, int]]) -> None:
        """Verify template ``k`` in the windows that hold place ``i`` and whose minimum stands there."""
        span = self.templates[k].span
        if any(k == o and s <= i - low < e - SHINGLE + 1 for o, s, e in found):
            return
        step = max(1, span // 8)
        last = max(low, high - span)
        starts = [low + g for g in range(max(0, -(-(i - span + 1 - low) // step)) * step, i - low + 1, step) if low + g <= last]
        for start in dict.fromkeys([*starts, *([last] if last <= i else [])]):
            if hashed[start : min(start + span, high)].min() == hashed[i] and self._verify(k, start, i, shingles, low, high, found):
                return

    def _verify(self, k: int, start: int, i: int, shingles: np.ndarray, low: int, high: int, found: list[tuple[int, int, int]]) -> bool:
        """Exact containment of the template in the window and half a window around it."""
        t = self.templates[k]
        a, b = max(low, start - t.span // 2), min(high, start + t.span + t.span // 2)
        hit = a + np.flatnonzero(np.isin(shingles[a:b], t.shingles))
        if len(np.unique(shingles[hit])) < CONTAINED * len(t.shingles):
            return False
        # the stretch of hits around the place, without gaps of half a template
        cut = np.flatnonzero(np.diff(hit) > max(SHINGLE, t.span // 2))
        part = np.searchsorted(hit[cut + 1], i, "right") if len(cut) else 0
        mine = np.split(hit, cut + 1)[part]
        if len(np.unique(shingles[mine])) < CONTAINED * len(t.shingles):
            mine = hit
        s, e = int(mine[0]) - low, int(mine[-1]) - low + SHINGLE
        if not any(k == o and s < y and x < e for o, x, y in found):
            found.append((k, s, e))
        return True


@functools.lru_cache(maxsize=4)
def library(items: tuple[tuple[str, str], ...]) -> Library:
    return Library(dict(items))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """License templates in every whole text.

    Words are those of ``str.split``, lower-cased and without punctuation at their ends;
    shingles have five words. ``Library`` retrieves templates by eight MinHash bands of
    windows as long as a template; one is counted if 0.8 or more of its different shingles
    lie in such a window and half a window around it. Templates under five words count
    where their words stand one after the other; one without words is an error. No rows
    move between tasks; the templates are a parameter of fixed size.

    A null or empty text has none; texts may be very long; ids null or repeated: each row
    gives one; an empty table none. Returns ``doc_id, n_matches, licenses`` (distinct names,
    sorted, comma-joined) and ``spans`` (``name:first word:end``, comma-joined, all inside
    the text). Matches of different templates may overlap.
    """
    items = tuple(sorted((templates or TEMPLATES).items()))

    def run(rows):
        found = library(items).scan([word_hashes((x or "").split()) for x in rows.column("text").to_pylist()])
        return {
            "doc_id": rows.column("doc_id"),
            "n_matches": [len(f) for f in found],
            "licenses": [",".join(sorted({n for n, _, _ in f})) for f in found],
            "spans": [",".join(f"{n}:{s}:{e}" for n, s, e in f) for f in found],
        }

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(source, run, "doc_id long, n_matches long, licenses string, spans string")
