"""License scans: overlapping text windows, MinHash bands, exact shingle containment.

A library of licence texts and notices is cut into sets of 5-word shingles (letters and digits, lower-cased).  A document is read
whole; each template looks at windows of its own length that overlap by three quarters, so some window holds the passage to within an eighth
of its length.  A window is retrieved as a candidate if it shares any of 32 minimum hashes with the template (32 bands of one
row): a passage that holds 75 % of a template's shingles gives a window of similarity 0.48 or more, which is missed with
probability 0.52^32, under 1e-9.  Candidates are then checked exactly: the share of the template's shingles that lie in the
window and half its length to either side must be 75 % or more.

Windows that hold no shingle of any template cannot match and are not hashed.  Templates shorter than five words are one shingle of their own length, which is looked for as such.  Of two alike templates
the better match counts where they match the same passage; elsewhere in the document the other one stands.  The library is a fixed table, the same for every input.

Defined cases.  Null, empty and blank texts have no licence: no names, 0 windows, a null ``best``; a null id is scanned like any other.  Ties: of alike
templates that match a place equally well each one stands.  Repeated rows are scanned separately and alike.  Texts of any length are read whole, batches are cut by bytes.  An
empty table gives no rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import WordHash, as_bytes, in_pieces, mix, seeds, shingle_hashes

BANDS = 32
CONTAINED = 75

# Names of licences as notices give them, and the notices and texts themselves.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License version 3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "CC0-1.0": ("Creative Commons Zero v1.0 Universal",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
}
NOTICES = ("Released under the {}", "Licensed under the {}", "Distributed under the {}", "This work is licensed under the {}", "Licensed under {}")
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}

#: What follows a text above in the whole licence.
REST = {
    "MIT": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_WORD = re.compile(rb"[a-z0-9]+")


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every template."""
    out = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    whole = {k: f"{TEXTS[k]} {rest}" for k, rest in REST.items()}
    whole["BSD-3-Clause"] = f"{TEXTS['BSD-2-Clause']} {TEXTS['BSD-3-Clause']} {REST['BSD-2-Clause']}"
    return out + list(TEXTS.items()) + list(whole.items())


class Library:
    """The templates' shingle sets and band index."""

    def __init__(self, texts: list[tuple[str, str]], k: int = 5):
        self.words, self.k = WordHash(), k
        self.seeds = seeds(BANDS, 77)
        kept: dict[tuple[str, bytes], np.ndarray] = {}
        short: dict[tuple[str, bytes], int] = {}
        for name, text in texts:
            raw = as_bytes(text)
            x = np.unique(self.shingles(raw))
            kept.setdefault((name, x.tobytes()), x)
            if 0 < (n := len(_WORD.findall(raw.lower()))) < k:
                short[name, x.tobytes()] = n
        self.names = [n for n, _ in kept]
        self.sets = list(kept.values())
        self.short: dict[int, list[int]] = {}  # words of a template with fewer than k of them -> templates
        for i, key in enumerate(kept):
            if key in short:
                self.short.setdefault(short[key], []).append(i)
        rest = [i for i, key in enumerate(kept) if key not in short]
        self.all = np.unique(np.concatenate([np.empty(0, np.uint64), *[self.sets[i] for i in rest]]))
        self.sizes = sorted({len(self.sets[i]) for i in rest})
        self.bands: dict[tuple[int, int, int], list[int]] = {}
        for i in rest:
            x = self.sets[i]
            for j, h in enumerate(self.minima(x)):
                self.bands.setdefault((len(x), j, int(h)), []).append(i)

    def shingles(self, raw: bytes) -> np.ndarray:
        return shingle_hashes(self.words.of(_WORD.findall(raw.lower())), self.k)

    def minima(self, x: np.ndarray) -> np.ndarray:
        return mix(x[None, :] ^ self.seeds[:, None]).min(axis=1)

    def scan(self, raw: bytes) -> tuple[int, dict[int, float]]:
        """Windows hashed, and template -> containment of those found."""
        w = self.words.of(_WORD.findall(raw.lower()))
        windows, found = 0, {}  # template -> containment, begin and end of each match
        for n, own in self.short.items():
            x = shingle_hashes(w, n) if len(w) >= n else w[:0]
            for i in own:
                at = np.flatnonzero(x == self.sets[i][0])
                windows += len(at)
                if len(at):
                    found[i] = [(1.0, a, a + 1) for a in at.tolist()]
        h = shingle_hashes(w, self.k)
        hit = np.flatnonzero(np.isin(h, self.all))
        for m in self.sizes if len(hit) else ():
            step = max(1, m // 4)
            first = np.unique(np.concatenate([np.maximum(0, (hit - m + step) // step + d) for d in range(-(-m // step))]))
            for a in (first * step).tolist():
                near = np.unique(h[a : a + m])
                if not len(near) or not np.isin(near, self.all, assume_unique=True).any():
                    continue
                windows += 1
                wide = None
                for i in {i for j, v in enumerate(self.minima(near).tolist()) for i in self.bands.get((m, j, v), ())}:
                    if wide is None:
                        wide = h[max(0, a - m // 2) : a + m + m // 2]
                    common = int(np.isin(self.sets[i], wide).sum())
                    if 100 * common >= CONTAINED * len(self.sets[i]):
                        own = a + np.flatnonzero(np.isin(h[a : a + m], self.sets[i]))
                        found.setdefault(i, []).append((common / len(self.sets[i]), int(own[0]), int(own[-1]) + 1))
        return windows, self.standing(found)

    def standing(self, found: dict[int, list[tuple[float, int, int]]]) -> dict[int, float]:
        """template -> its best containment, of matches that no alike template matches better in the same place (over half of it)."""
        spots, out = {i: np.array(v) for i, v in found.items()}, {}
        for i, own in found.items():
            rivals = [spots[j] for j in found if j != i and self.alike(i, j)]
            other = np.concatenate(rivals) if rivals else np.empty((0, 3))
            for c, begin, end in sorted(own, reverse=True):
                shared = np.minimum(other[:, 2], end) - np.maximum(other[:, 1], begin)
                if not ((other[:, 0] > c) & (2 * shared > end - begin)).any():
                    out[i] = c
                    break
        return out

    def alike(self, i: int, j: int) -> bool:
        """Whether template i says mostly what j says; the better match of such two counts."""
        return 2 * int(np.isin(self.sets[i], self.sets[j]).sum()) >= len(self.sets[i])


_library: dict[tuple, Library] = {}


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_windows, licenses (sorted names, comma-separated), n_licenses, best (largest containment, null if none)."""
    held = tuple(texts or templates())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library.get(held) or _library.setdefault(held, Library(list(held)))
        for batch in in_pieces(batches):
            n, names, count, best = [], [], [], []
            for text in batch.column(1).to_pylist():
                windows, found = library.scan(as_bytes(text))
                own = sorted({library.names[i] for i in found})
                for c, v in zip((n, names, count, best), (windows, ",".join(own), len(own), max(found.values(), default=None))):
                    c.append(v)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(count, pa.int64()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_windows", "licenses", "n_licenses", "best"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_windows long, licenses string, n_licenses long, best double")
