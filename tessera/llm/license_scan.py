"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of ASCII letters and digits (and of any other non-ASCII
characters), lower-cased. Templates are classed by length, in 5-word shingles:
1, 2, 3, 4, 6, 8, 12 and so on, each rounded up. For the class of h a document is
cut into windows of 2h shingles, each overlapping half of the next, so a passage
as long as the template lies whole in some window. A window that holds 75 % of a
template's shingles has a Jaccard similarity of at least 0.23 to it; with
``BANDS`` bands of one minhash, one of them retrieves the template with
probability 1 - (1 - 0.23)^40 > 0.9999. Templates of 2 and 3 shingles have to be
there whole, a similarity of 0.5, for which half the bands miss one in a million;
those of one shingle have windows of one, which always meet them. Each retrieved pair of window and template is then
judged by exact containment on the full shingle sets, over the window and one
more to either side, for passages with words put in.

Window minima come from minima of half windows, and those of a class from the
class of half its length, so a text is hashed once and the work of all classes is
a few passes over it. Long texts are hashed in pieces. The work is one pass over
the texts in Arrow batches: nothing is shuffled; the templates, a bounded list,
go with the code.

Defined results
- null or empty text, or one without words: no match.
- a document or template of fewer than 5 words: its one shingle is the whole sequence; a template without words matches nothing.
- null doc_id and repeated rows: scanned like any other.
- an empty table or no templates: empty result. Of equally contained windows the first is given.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bare, small_batches, written
from tessera.llm.near_dedup import SHINGLE, WordHashes, mixed, numbers

BANDS = 40
CONTAINMENT = 0.75
#: Shingles hashed at a time: a multiple of the blocks of 8 and 12; and what windows of up to 12 read beyond them.
PIECE, BEYOND = 2040, 12
LOW_BITS = np.uint64((1 << 18) - 1)
#: Templates go to every task with the code, so their total size is checked.
MAX_TEMPLATE_BYTES = 16 << 20
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))

#: Fixed texts of common notices and short lines.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "MIT-line-licensed": "Licensed under the MIT License.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
}
#: Whole license texts, by file name.
TEMPLATES |= {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def ordered_shingles(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, int]:
    """The shingles' hashes in order of place, and the number of words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(KEEP).split()
    if not words:
        return np.empty(0, np.uint64), 0
    h = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    size = min(SHINGLE, len(h))
    factors = numbers(SHINGLE, 51 + size)
    s = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        s = s + h[i : len(s) + i] * factors[i]
    return mixed(s), len(h)


def class_of(n: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, ... that isn't less than n."""
    if n == 1:
        return 1
    power = 2
    while power < n:
        power *= 2
    return 3 * power // 4 if power > 2 and 3 * power // 4 >= n else power


def blocked(low: np.ndarray, size: int) -> np.ndarray:
    """The minima of blocks of ``size`` columns; the last may be shorter."""
    whole = low.shape[1] // size * size
    out = low[:, :whole:size]
    for i in range(1, size):
        out = np.minimum(out, low[:, i:whole:size])
    return out if whole == low.shape[1] else np.concatenate([out, low[:, whole:].min(axis=1, keepdims=True)], axis=1)


class Index:
    """Templates by length class; each class has the sorted minima of its templates, and whose they are."""

    def __init__(self, templates: Mapping[str, str], bands: int = BANDS) -> None:
        hashes = WordHashes()
        self.mask, self.factor = numbers(bands, 71)[:, None], numbers(bands, 83)[:, None]
        self.names, self.sets = [], []
        by_class: dict[int, list[int]] = {}
        for name, text in sorted(templates.items()):
            s, _ = ordered_shingles(text, hashes)
            if len(s):
                by_class.setdefault(class_of(len(s)), []).append(len(self.names))
                self.names.append(name)
                self.sets.append(np.unique(s))
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for half, which in by_class.items():
            # a window of one shingle is its own minimum
            used = 1 if half == 1 else bands // 2 if half < 4 else bands
            keys = np.concatenate([self.sets[i] if half == 1 else self.hashed(self.sets[i])[:used].min(axis=1) for i in which])
            owner = np.repeat(which, used)
            order = np.argsort(keys, kind="stable")
            some = np.zeros(int(LOW_BITS) + 1, bool)  # which low bits keys have, to look up few others
            some[keys & LOW_BITS] = True
            self.classes[half] = some, keys[order], owner[order]

    def hashed(self, s: np.ndarray) -> np.ndarray:
        return (s[None, :] ^ self.mask) * self.factor

    def met(self, low: np.ndarray, half: int, most: int) -> set[tuple[int, int]]:
        """(template, window) where a window's minimum is a template's; of the first ``most`` windows."""
        some, keys, owner = self.classes[half]
        low = low[: len(low) // 2] if 1 < half < 4 else low
        low = np.minimum(low[:, :most][:, : max(1, low.shape[1] - 1)], low[:, 1 : most + 1]) if half > 1 and low.shape[1] > 1 else low[:, :most]
        out = set()
        for place in np.flatnonzero(some[low & LOW_BITS]):
            b, w = divmod(int(place), low.shape[1])
            for k in range(*np.searchsorted(keys, [low[b, w], low[b, w] + np.uint64(1)])):
                out.add((int(owner[k]), w))
        return out

    def retrieved(self, s: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first, end): windows of shingles that share a band with a template of their class, and a window more to either side."""
        near = lambda half, w, i=0: (max(0, i + (w - 2) * half), min(len(s), i + (w + 4) * half))
        if 1 in self.classes:
            for template, w in sorted(self.met(s[None, :], 1, len(s))):
                yield template, w, w + 1
        blocks: dict[int, list[np.ndarray]] = {8: [], 12: []}
        for i in range(0, len(s), PIECE):
            own = self.hashed(s[i : i + PIECE + BEYOND])
            for base in (2, 3):
                low = blocked(own, base)
                for half in (base, 2 * base):
                    low = low if half == base else blocked(low, 2)
                    if half in self.classes:
                        for template, w in sorted(self.met(low, half, PIECE // half)):
                            yield template, *near(half, w, i)
                blocks[4 * base].append(blocked(low[:, : PIECE // (2 * base)], 2))
        for half, parts in blocks.items():
            low = np.concatenate(parts, axis=1) if parts else np.empty((len(self.mask), 0), np.uint64)
            while low.shape[1] and half <= max(self.classes):
                if half in self.classes:
                    for template, w in sorted(self.met(low, half, low.shape[1])):
                        yield template, *near(half, w)
                low, half = blocked(low, 2), 2 * half

    def matches(self, text: str | None, hashes: WordHashes, containment: float) -> list[tuple[str, float, int, int]]:
        s, n_words = ordered_shingles(text, hashes)
        if not len(s) or not self.names:
            return []
        best: dict[int, tuple[float, int, int]] = {}
        for template, first, end in self.retrieved(s):
            own = self.sets[template]
            place = np.searchsorted(own, s[first:end])
            place[place == len(own)] = 0
            found = np.flatnonzero(own[place] == s[first:end])
            part = len(np.unique(place[found])) / len(own)
            if part >= containment and part > best.get(template, (0.0,))[0]:
                best[template] = (part, first + int(found[0]), min(n_words, first + int(found[-1]) + SHINGLE))
        return [(self.names[t], *x) for t, x in sorted(best.items())]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document and template that it holds: doc_id, license, containment, word_start, word_end."""
    if sum(len(x) for x in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError("too many templates to send with the code")
    templates = dict(templates)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            index, hashes = Index(templates), WordHashes()
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in index.matches(t.as_py(), hashes, containment)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "license", "containment", "word_start", "word_end"])

    docs = bare(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    with small_batches(docs.sparkSession):
        return written(docs.mapInArrow(found, "doc_id long, license string, containment double, word_start long, word_end long"), "licenses")
