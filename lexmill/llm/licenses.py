"""License scan: stretches of normalised text against license templates, by the Dice coefficient of word bigrams."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import U64, mix, slices
from lexmill.llm.decontaminate import token_hashes

#: Public license texts and notices, by their SPDX names. Names and years are left out of them.
_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _PERMIT + " " + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", _BSD + " " + _BSD_END),
    ("BSD-3-Clause", _BSD + " " + _BSD_3 + " " + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
#: Spellings that count as one word.
SAME = (("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"))


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word pairs of all rows, each row's first pair, and each row's number of words."""
    tokens, first = token_hashes(column)
    pairs = pa.array([w for pair in SAME for w in pair])
    for said, meant in token_hashes(pairs)[0].reshape(-1, 2).tolist():
        tokens[tokens == U64(said)] = U64(meant)
    many = np.diff(first)
    row = np.repeat(np.arange(len(many)), many)
    if len(tokens) < 2:
        return np.zeros(0, U64), np.zeros(len(first), np.int64), many
    at = np.flatnonzero(row[1:] == row[:-1])
    return mix(tokens[at] * U64(3) ^ (tokens[at + 1] * U64(0xD1342543DE82EF95))), np.searchsorted(row[at], np.arange(len(first))), many


class Templates:
    def __init__(self, templates, least: float) -> None:
        self.names = [name for name, _ in templates]
        pairs, first, _ = bigrams(pa.array([text for _, text in templates], pa.string()))
        self.sizes = np.diff(first)
        self.least = least
        row = np.repeat(np.arange(len(templates)), self.sizes)
        known, self.times = np.unique(np.stack([pairs.view(np.int64), row], axis=1), axis=0, return_counts=True) if len(pairs) else (np.zeros((0, 2), np.int64),) * 2
        self.keys, self.owners = known[:, 0], known[:, 1]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.keys & ((1 << 18) - 1)] = True

    def stretches(self, pairs: np.ndarray) -> list[tuple[int, float, int, int]]:
        """template, dice, first pair, pairs: the stretches of one text that reach the least, without a word in common.

        The one most alike comes first (then the longer, the earlier template, the earlier stretch), then the best of those
        beside it, until none is left. A lazy heap holds the best stretch from each start; one that what is taken has cut is
        sought again in the room that is left to it.
        """
        at = np.flatnonzero(self.maybe[pairs.view(np.int64) & ((1 << 18) - 1)])
        if not len(at):
            return []
        key = pairs[at].view(np.int64)
        begin, end = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        many = end - begin
        spot = np.repeat(at, many)
        which = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        owner = self.owners[which]
        hits = np.bincount(owner, minlength=len(self.names))
        windows, heap = {}, []
        for t in np.flatnonzero((hits > 0) & (hits * (2 - self.least) >= self.least * self.sizes - 1e-9)).tolist():
            mine = owner == t
            windows[t] = own = Windows(spot[mine], which[mine], self.times[which[mine]], int(self.sizes[t]), self.least)
            heap += [(-d, -n, t, s, i) for d, n, s, i in own.best(own.starts())]
        heapq.heapify(heap)
        firsts, taken, out = [], [], []
        while heap:
            d, n, t, s, i = heapq.heappop(heap)
            k = bisect.bisect_right(firsts, s)
            if k and s <= taken[k - 1]:  # the last word of the stretch before
                continue
            if k < len(firsts) and s - n >= firsts[k]:
                for d, n, s, i in windows[t].best(np.array([i]), firsts[k] - 2):
                    heapq.heappush(heap, (-d, -n, t, s, i))
                continue
            firsts.insert(k, s)
            taken.insert(k, s - n)
            out.append((t, -d, s, -n))
        return out


class Windows:
    """The stretches of a text that begin and end with a pair of one template: of any others, a part is more alike.

    spot: where pairs of the template stand; which: what pairs they are; times: how often the template has that pair.
    """

    def __init__(self, spot: np.ndarray, which: np.ndarray, times: np.ndarray, size: int, least: float) -> None:
        self.spot, self.size, self.least = spot, size, least
        order = np.argsort(which, kind="stable")
        back = np.arange(len(order)) - times[order]
        same = (back >= 0) & (which[order[np.maximum(back, 0)]] == which[order])
        self.full = np.full(len(order), -1)  # a pair counts if a stretch begins after this one, else there are enough of it
        self.full[order[same]] = order[back[same]]
        self.stop = np.searchsorted(spot, spot + int((2 - least) / least * size + 1e-9))  # longer ones cannot reach the least

    def starts(self) -> np.ndarray:
        """Starts from which some stretch may reach the least.

        With m of a stretch's L pairs in a template of B, dice is at most 2m / (L + B). So the sum of 2 for a pair of the
        template and -least for any pair must reach least*B.
        """
        k = np.arange(len(self.spot))
        gain = 2.0 * (k + 1) - self.least * (self.spot + 1)  # up to and with each hit
        high = np.maximum.accumulate(gain[::-1])[::-1]
        return np.flatnonzero(high - (2.0 * k - self.least * self.spot) >= self.least * self.size - 1e-9)

    def best(self, starts: np.ndarray, last: int | None = None) -> Iterator[tuple[float, int, int, int]]:
        """dice, pairs, first pair, start: the best stretch from each start, if it reaches the least; up to pair `last`."""
        stop = self.stop[starts] if last is None else np.minimum(self.stop[starts], np.searchsorted(self.spot, last, "right"))
        starts, stop = starts[stop > starts], stop[stop > starts]
        width = int((stop - starts).max()) if len(starts) else 1
        step = max(1, (1 << 18) // width)
        for i in range(0, len(starts), step):
            own = starts[i : i + step, None]
            at = own + np.arange(width)
            inside = at < stop[i : i + step, None]
            at = np.minimum(at, len(self.spot) - 1)
            n = self.spot[at] - self.spot[own] + 1
            d = np.where(inside, 2 * np.cumsum(self.full[at] < own, axis=1) / (n + self.size), 0)
            j = width - 1 - np.argmax(d[:, ::-1], axis=1)  # the longest of those that are equally alike
            row = np.flatnonzero(d[np.arange(len(j)), j] >= self.least - 1e-12)
            yield from zip(d[row, j[row]].tolist(), n[row, j[row]].tolist(), self.spot[own[row, 0]].tolist(), own[row, 0].tolist(), strict=True)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, template, dice, first_word, n_words: what licenses each of docs (doc_id, text) carries, and where.

    Every stretch of a text counts that is like a template from a Dice coefficient of `least`, so a license that stands twice
    gives two rows; of stretches that overlap, the one most alike stays (then the longer, then the earlier template). Texts are normalised: lower case, runs of letters and
    digits, one spelling of "license". Null and short texts carry nothing; a document may have several rows or none; repeated
    rows and null ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    schema = "doc_id long, license string, template int, dice double, first_word long, n_words long"
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                pairs, first, _ = bigrams(batch.column(1).slice(a, b - a))
                seen = np.concatenate([[0], np.cumsum(known.maybe[pairs.view(np.int64) & ((1 << 18) - 1)])])
                out = []
                for i in np.flatnonzero(np.diff(seen[first]) > 0).tolist():
                    doc = batch.column(0)[a + i].as_py()
                    out += [(doc, known.names[t], t, d, s, n + 1) for t, d, s, n in known.stretches(pairs[first[i] : first[i + 1]])]
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
