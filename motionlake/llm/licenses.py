"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

The inverted index holds the winnowed word 3-grams of each template.  Where a document's winnowed
grams hit it, document and template words are aligned in a band around the diagonal of the hits.
"""

from __future__ import annotations

from bisect import bisect, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import GramIndex, code_points, local_alignment
from .common import TooLarge, id_type
from .textvec import PLAIN_WORDS, slices, text_buffers, words

#: Words of a gram and grams of a window: any run of GRAM + WINDOW - 1 equal words shares a fingerprint.
GRAM, WINDOW = 3, 3
#: Bytes of templates that are broadcast at most.
TEMPLATE_BYTES = 32 << 20

#: Notices and grants of well-known licenses (name, text), then whole texts of short ones.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)


def winnow(grams: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions of grams that are the least of a window of WINDOW grams of one document.

    A document with fewer grams keeps all of them.
    """
    n = len(grams)
    chosen = np.zeros(n, bool)
    whole = inside.copy()
    for k in range(1, WINDOW):
        whole[: n - k] &= inside[k:]
        whole[n - k :] = False
    least = grams.copy()
    for k in range(1, WINDOW):
        np.minimum(least[: n - k], grams[k:], out=least[: n - k])
    for k in range(WINDOW):
        at = np.flatnonzero(whole[: n - k])
        chosen[at[grams[at + k] == least[at]] + k] = True
    # ends of documents whose grams fill no window
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[k:] |= whole[: n - k]
    return np.flatnonzero(inside & (chosen | ~covered))


def copies(template: np.ndarray, text: np.ndarray, at: np.ndarray, place: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(matched, start, end) of alignments of ``template`` with at least ``least`` matched words around hits.

    at and place are the hits' words in text and template.  First comes the diagonal in the middle of
    the hits.  Where it holds a copy, the hits before and after the copy are searched in the text on
    their side of it, so that adjacent copies are all found; where it does not, each half of the hits.
    """
    band = max(8, len(template) // 4)
    keys, count = np.unique(template, return_counts=True)
    found, tried, todo = [], set(), [(np.argsort(at, kind="stable"), 0, len(text))]
    while todo:
        hits, lo, hi = todo.pop()
        if not len(hits):
            continue
        diagonal = int(np.median(at[hits] - place[hits]))
        a, b = max(lo, diagonal - band), min(hi, diagonal + len(template) + band)
        matched = 0
        if (diagonal, a, b) not in tried and b - a >= least:
            tried.add((diagonal, a, b))
            # no alignment matches more words than template and text have in common
            key = np.minimum(np.searchsorted(keys, text[a:b]), len(keys) - 1)
            common = np.bincount(key[keys[key] == text[a:b]], minlength=len(keys))
            if np.minimum(common, count).sum() >= least:
                _, matched, s, e = local_alignment(template, text[a:b], diagonal - a, band)
        if matched and matched >= least:
            found.append((matched, a + s, a + e))
            todo.append((hits[at[hits] < a + s], lo, a + s))
            todo.append((hits[at[hits] >= a + e], a + e, hi))
        elif len(hits) > 1:
            todo.append((hits[: len(hits) // 2], lo, hi))
            todo.append((hits[len(hits) // 2 :], lo, hi))
    return found


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_coverage: float = 0.8) -> DataFrame:
    """(id, license, template, coverage, start, end) of the license texts in each document.

    Words are runs of letters and digits, A-Z lower-cased; coverage is the share of the template's
    words that the alignment matches, ``template`` its index, start and end are code points.  Of
    overlapping finds the one with the most matched words stays, then the higher coverage, then the
    earlier template.  Templates shorter than GRAM words are never found.  Null and empty texts have
    no license; rows are independent, so repeated ids give repeated rows; an empty table gives none.
    Documents are never shuffled; templates are broadcast after a check of their size.
    """
    if sum(len(t.encode()) for _, t in templates) > TEMPLATE_BYTES:
        raise TooLarge(f"templates have over {TEMPLATE_BYTES} bytes")
    w = words(*text_buffers(pa.array([t for _, t in templates], pa.string())), PLAIN_WORDS)
    grams, inside = w.shingles(GRAM)
    at = winnow(grams, inside)
    owner = np.searchsorted(w.ptr, at, "right") - 1
    sequences = [w.h[a:b] for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast((GramIndex(grams[at], owner, at - w.ptr[owner]), sequences, [n for n, _ in templates]))

    def scan(batches):
        index, sequences, names = shared.value
        size = np.array([len(s) for s in sequences], np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column("text"))
                w = words(data, offsets, PLAIN_WORDS)
                grams, inside = w.shingles(GRAM)
                prints = winnow(grams, inside)
                hit, key = index.find(grams[prints])
                at, item, place = index.expand(prints[hit], key)
                doc = np.searchsorted(w.ptr, at, "right") - 1
                order = np.lexsort((at, item, doc))
                at, item, place, doc = at[order], item[order], place[order], doc[order]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(at - place) > np.maximum(8, size[item[1:]] // 4))
                first = [*np.flatnonzero(fresh).tolist(), len(at)]
                found = []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    d, t = int(doc[a]), int(item[a])
                    lo, hi = int(w.ptr[d]), int(w.ptr[d + 1])
                    for matched, s, e in copies(sequences[t], w.h[lo:hi], at[a:b] - lo, place[a:b], min_coverage * len(sequences[t])):
                        found.append((d, -matched, -matched / len(sequences[t]), t, lo + s, lo + e))
                ids, rows, taken = part.column("id").to_pylist(), [], []
                for d, _, coverage, t, s, e in sorted(found):
                    near = bisect(taken, (s, e))  # spans taken do not overlap, so only the neighbours can
                    if not any(s < f and b < e for b, f in taken[max(0, near - 1) : near + 1]):
                        insort(taken, (s, e))
                        text = data[offsets[d] : offsets[d + 1]]
                        start, end = code_points(text, [int(w.start[s] - offsets[d]), int(w.end[e - 1] - offsets[d])])
                        rows.append((ids[d], names[t], t, -coverage, start, end))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [part.column("id").type, pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "license", "template", "coverage", "start", "end"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(scan, f"id {id_type(docs, id_col)}, license string, template int, coverage double, start long, end long")
