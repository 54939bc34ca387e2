"""License scan: MinHash bands over overlapping windows, then exact containment (operator 7)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import column_bytes, slices, table

SHINGLE = 5
# Notices by which common licenses are granted.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-sa-3.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "gfdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}
#: ASCII letters in lower case; other ASCII characters but digits become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


@dataclass(frozen=True)
class Bands:
    """``bands`` of ``rows`` values each. ``overlap``: windows of n words begin every n // overlap words."""

    bands: int = 24
    rows: int = 2
    containment: float = 0.8
    overlap: int = 8

    def collision(self, similarity: float) -> float:
        """The probability that a window and a template of that Jaccard similarity share a band."""
        return 1 - (1 - similarity**self.rows) ** self.bands

    def least(self) -> float:
        """The least similarity of a template and the best placed window of its length that contains enough of it."""
        shared = self.containment - 0.5 / self.overlap
        return shared / (2 - shared)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Each five words in a row; all of them, if there are fewer."""
    return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [tuple(words)] if words else []


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """(len(h), n): each hash under n functions, which multiply and add odd and other numbers that follow a rule."""
    k = np.arange(1, n + 1, dtype=np.uint64)
    a = k * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    x = (h[:, None] ^ h[:, None] >> np.uint64(31)) * a + k * np.uint64(0xD1342543DE82EF95)
    return x ^ x >> np.uint64(29)


def _hashes(items: list[tuple[bytes, ...]]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in items], np.uint64)


def signature(items: list[tuple[bytes, ...]], n: int) -> np.ndarray:
    """MinHash values under n hash functions."""
    return _mixed(_hashes(items), n).min(axis=0)


def _window_minima(place: np.ndarray, h: np.ndarray, size: int, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, MinHash values) of the windows that begin at each multiple of ``step`` and have about ``size`` places.

    ``place``: ascending places with hash ``h``; others have none. The least of each block of ``step`` places is taken once, and a
    window's values are the least of its blocks', so a place is hashed once however many windows overlap there.
    """
    block = place // step
    new = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ids, parts = block[new], []
    bounds = np.r_[new, len(place)]
    for i in range(0, len(new), 2000):
        a, b = bounds[i], bounds[min(i + 2000, len(new))]
        parts.append(np.minimum.reduceat(_mixed(h[a:b], n), new[i : i + 2000] - a, axis=0))
    least = np.concatenate(parts)
    blocks = -(-size // step)
    begins = np.unique((ids[:, None] - np.arange(blocks)).ravel())
    begins = begins[begins >= 0]
    found = np.full((len(begins), n), np.iinfo(np.uint64).max, np.uint64)
    for k in range(blocks):
        at = np.minimum(np.searchsorted(ids, begins + k), len(ids) - 1)
        here = ids[at] == begins + k
        found[here] = np.minimum(found[here], least[at[here]])
    return begins * step, found


class Templates:
    """Band tables of the templates, by their number of words."""

    def __init__(self, texts: dict[str, str], settings: Bands) -> None:
        self.settings = settings
        self.shingles = {k: set(shingles(words_of(t.encode()))) for k, t in texts.items()}
        self.shingles = {k: s for k, s in self.shingles.items() if s}
        self.vocabulary = {w: 1 for x in self.shingles.values() for item in x for w in item}
        #: Shingles of the templates, by those templates' number of words.
        self.near: dict[int, set[tuple[bytes, ...]]] = defaultdict(set)
        self.tables: dict[int, dict[tuple[int, bytes], set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, items in self.shingles.items():
            n = len(words_of(texts[name].encode()))
            self.near[n] |= items
            for key in self._keys(list(items)):
                self.tables[n][key].add(name)

    def _keys(self, items: list[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
        yield from self._bands(signature(items, self.settings.bands * self.settings.rows))

    def _bands(self, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
        rows = self.settings.rows * values.itemsize
        raw = values.tobytes()
        return ((i, raw[i * rows : (i + 1) * rows]) for i in range(self.settings.bands))

    def _windows(self, words: list[bytes], hits: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, signature) of the windows around ``hits``: of n words; and, so that words put into a notice don't push
        its end out, of as many hits as n words have shingles."""
        width = min(SHINGLE, n)
        size, values = n - width + 1, self.settings.bands * self.settings.rows
        near = np.zeros(len(words) - width + 2, np.int64)
        np.add.at(near, np.maximum(hits - 2 * size, 0), 1)
        np.add.at(near, np.minimum(hits + 2 * size, len(near) - 1), -1)
        place = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(b" ".join(words[i : i + width])) for i in place.tolist()], np.uint64)
        own = h[np.searchsorted(place, hits)]
        for where, part, seen in ((place, h, None), (np.arange(len(hits)), own, hits)):
            step = max(1, (size if seen is not None else n) // self.settings.overlap)
            first, found = _window_minima(where, part, size, step, values)
            for a, x in zip(first.tolist(), found, strict=True):
                yield (a if seen is None else int(seen[min(a, len(seen) - 1)])), x

    def scan(self, text: bytes | None) -> dict[str, tuple[float, int, int]]:
        """For each template found: its containment in the text, the windows that led to it, the first word of the first.

        A window without any shingle of a template is similar to none, so only the windows around those are looked up. They
        only retrieve: containment is counted exactly over the whole text, so it doesn't depend on where windows begin.
        """
        words = words_of(text)
        get = self.vocabulary.get
        known = np.fromiter((get(w, 0) for w in words), np.int8, len(words))
        if not known.any():
            return {}
        found: dict[str, tuple[float, int, int]] = {}
        places: dict[int, list[int]] = {}
        for n, bands in self.tables.items():
            width = min(SHINGLE, n)
            if len(words) < width:
                continue
            if width not in places:
                ends = np.convolve(known, np.ones(width, np.int64))[width - 1 : len(words)]
                places[width] = np.flatnonzero(ends == width).tolist()
            hits = [(i, x) for i in places[width] if (x := tuple(words[i : i + width])) in self.near[n]]
            if not hits:
                continue
            have = {x for _, x in hits}
            share: dict[str, float] = {}  # of the templates that were retrieved
            for s, values in self._windows(words, np.array([i for i, _ in hits]), n):
                for name in set().union(*(bands.get(key, ()) for key in self._bands(values))):
                    if name not in share:
                        share[name] = len(self.shingles[name] & have) / len(self.shingles[name])
                    if share[name] >= self.settings.containment:
                        _, times, first = found.get(name, (share[name], 0, s))
                        found[name] = (share[name], times + 1, min(first, s))
        return found


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None, settings: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): a row for each text and template that it contains.

    Windows of each template's length, one every eighth of it, are looked up by the bands of their MinHash signatures: windows
    of words, and of the text's shingles that such a template has, whatever stands between them. The best placed window around
    the asked share of a template's shingles collides with a probability of
    ``settings.collision(settings.least())``, over 0.9999. Exact containment of five-word shingles in the whole text
    decides. n_windows: those that collided; first_word: of the first. The templates (a few, given by the caller) go with the tasks; nothing is shuffled.
    Null, empty and short texts match nothing (a template of under five words is one shingle of that length); rows without an id and repeated rows are
    scanned each. An empty table gives an empty result; further columns aren't read.
    """
    found = Templates(TEMPLATES if templates is None else templates, settings)
    found.tables = {n: dict(x) for n, x in found.tables.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            rows = [(i, name, *x) for i, text in enumerate(column_bytes(batch, "t")) for name, x in sorted(found.scan(text).items())]
            at, name, share, times, first = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(times, pa.int64()), pa.array(first, pa.int64())], names=["doc_id", "license", "containment", "n_windows", "first_word"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, license string, containment double, n_windows long, first_word long")


def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))
