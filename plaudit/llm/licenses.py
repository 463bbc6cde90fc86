"""License scans by patience alignment of texts with license templates.

Anchors are words that stand once in the text and once in the template. The longest increasing run
of anchors (by patience sorting) is aligned; then each gap between two of them is aligned the same
way, with words that are unique inside the gap, and where none is left the common words at both
ends of a gap are matched. The share of a template's words that are aligned is its coverage.

Only words of the templates matter, so a text shrinks to those first. A bound by word counts, which
coverage cannot exceed, spares most alignments and loses none.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm import arrays as A

COVERAGE = 0.8

# Notices and texts of public licenses, in their usual wording.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def longest_run(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run, by patience sorting."""
    tops: list[int] = []  # values on top of the piles
    at: list[int] = []  # and their places
    before = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect.bisect_left(tops, value)
        if pile:
            before[i] = at[pile - 1]
        if pile == len(tops):
            tops.append(value)
            at.append(i)
        else:
            tops[pile], at[pile] = value, i
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(i)
        i = before[i]
    return run[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (place in text, place in template), increasing in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        if a >= b or c >= d:
            continue
        in_template = Counter(template[c:d])
        once = {w for w, n in in_template.items() if n == 1}
        in_text = Counter(w for w in text[a:b] if w in once)
        where = {w: i for i, w in enumerate(text[a:b], a) if in_text.get(w) == 1}
        anchors = [(where[w], j) for j, w in enumerate(template[c:d], c) if w in where]
        if anchors:
            run = [anchors[k] for k in longest_run([i for i, _ in anchors])]
            found += run
            for (i, j), (k, l) in zip([(a - 1, c - 1), *run], [*run, (b, d)], strict=True):
                gaps.append((i + 1, k, j + 1, l))
            continue
        while a < b and c < d and text[b - 1] == template[d - 1]:  # no anchor: from both ends
            b, d = b - 1, d - 1
            found.append((b, d))
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
    return sorted(found)


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, licenses: those covered to ``coverage`` or more, best first.

    Each has name, matched words, words of the template, coverage, first_word and last_word (places
    among the text's words, counted from 0). Words are runs of letters, digits and non-ASCII
    characters, A-Z lowered. Null, empty and wordless texts hold none; ties go by name; repeated rows
    come out alike; empty tables and other columns do no harm. A wordless template is never found.
    """
    names = sorted(templates)
    vocabulary: dict[bytes, int] = {}
    cut: list[list[int]] = []
    for name in names:
        words = A.words_of(pa.array([templates[name]]), A.ALNUM)
        cut.append([vocabulary.setdefault(words.word(i), len(vocabulary)) for i in range(len(words.starts))])
    known = A.words_of(pa.array([" ".join(w.decode() for w in vocabulary)]), A.ALNUM)
    hashes = A.word_hashes(known)
    order = np.argsort(hashes)
    sorted_hashes = hashes[order]
    needed = np.zeros((len(names), len(vocabulary)), np.int64)
    for t, words in enumerate(cut):
        np.add.at(needed[t], words, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [("name", pa.string()), ("matched", pa.int32()), ("words", pa.int32()), ("coverage", pa.float64()),
                 ("first_word", pa.int32()), ("last_word", pa.int32())]
            )
        )
        for batch in A.blocks(batches):
            words = A.words_of(batch.column("text"), A.ALNUM)
            seen = A.word_hashes(words)
            at = np.minimum(np.searchsorted(sorted_hashes, seen), max(len(sorted_hashes) - 1, 0))
            hit = np.flatnonzero(sorted_hashes[at] == seen) if len(sorted_hashes) and len(seen) else np.zeros(0, np.int64)
            ids = order[at[hit]] if len(hit) else np.zeros(0, np.int64)
            bounds = np.searchsorted(hit, words.bounds)
            out = []
            for doc in range(batch.num_rows):
                mine = ids[bounds[doc] : bounds[doc + 1]]
                held = np.minimum(np.bincount(mine, minlength=len(vocabulary)), needed).sum(1) if len(mine) else np.zeros(len(names))
                rows = []
                for t in np.flatnonzero((held >= coverage * needed.sum(1)) & (held > 0)).tolist():
                    pairs = align(mine.tolist(), cut[t])
                    share = len(pairs) / len(cut[t])
                    if share >= coverage:
                        places = hit[bounds[doc] :][[pairs[0][0], pairs[-1][0]]] - words.bounds[doc]
                        rows.append(
                            {"name": names[t], "matched": len(pairs), "words": len(cut[t]), "coverage": share,
                             "first_word": int(places[0]), "last_word": int(places[1])}
                        )
                out.append(sorted(rows, key=lambda r: (-r["coverage"], -r["matched"], r["name"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "licenses"])

    schema = (
        "doc_id long, licenses array<struct<name:string,matched:int,words:int,coverage:double,"
        "first_word:int,last_word:int>>"
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
