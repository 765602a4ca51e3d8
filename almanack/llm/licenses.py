"""License scans by conditional compression.

A license word of a text opens candidate blocks: for each template that has the word, the words of the text on which the template would lie, of the template's own size (and as
many more as may differ, for a long one). Each block is compressed alone and with the templates of its size as zstandard raw dictionary, and all are ranked by the bytes saved. What saves
less than the notice itself would cannot be it and goes no further; down the rest the first whose wording is confirmed wins: block and template are aligned word by word, and the words that
differ must stay within the share that the template states (none at all for a short notice: one word more or less, or another version, makes another license). So of two texts that both lie there, one inside
the other or alike but for some words, the one that explains more of the block is given.

Cases: null and empty texts have no block; repeated lines and rows are scanned each for itself (a task remembers blocks that it has compressed, up to a bound);
equal savings rank by license name; very long lines and texts are cut at no length; an empty table gives no rows; only doc_id and text
are read. Texts without a license word never leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may stand between the words of one license word: blanks, line ends and signs of comments.
_GAP = r"[ \t\r\n*#/;%>!|-]+"
#: Words of lines that are looked at (Java and Python pattern alike).
WORD = rf"(?i)licen[sc]|copyright|permission|warrant|redistribut|public{_GAP}domain|all{_GAP}rights{_GAP}reserved|\bCC(?:0|{_GAP}(?:BY|0))|\bGPL|\bSPDX"

#: Of the words of a whole license text, how many may differ.
TEXT = 0.1
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
#: Names that an SPDX line may give.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib"]
#: License notices, one or more to an SPDX name, each with the share of its words that may differ.
TEMPLATES: list[tuple[str, str, float]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", 0.0),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', TEXT),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", 0.0),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", 0.0),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", 0.0),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", 0.0),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", 0.0),
    ("CC0-1.0", "Released under CC0 1.0.", 0.0),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2.", 0.0),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3.", 0.0),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", TEXT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", TEXT),
    ("MIT", "Released under the MIT License.", 0.0),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', TEXT),
    ("MIT", "Licensed under the MIT License.", 0.0),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", TEXT),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, TEXT),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, TEXT),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", 0.0),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", 0.0),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", 0.0),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", 0.0),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", 0.0),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", 0.0),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", 0.0),
    ("GPL-2.0-only", "Licensed under the GPL-2.0.", 0.0),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", TEXT),
    ("GPL-3.0-only", "Licensed under the GPL-3.0.", 0.0),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", TEXT),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", TEXT),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", TEXT),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved.", 0.0),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", 0.0),
    *((x, f"SPDX-License-Identifier: {x}", 0.0) for x in SPDX),
]
_REMEMBERED = 50_000
#: Of the bytes that a long template saves on itself, the share that a block must save to be read word by word. Of templates with a tenth of their words changed at random, the least share seen was 0.75; none below LEAST is proven impossible.
LEAST = 0.25
#: A short notice that goes on so is another one (`GPL-2.0+`, `BSD-3-Clause-Clear`).
_GOES_ON = re.compile(r"\+|-\w")


_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return [x.lower() for x in _WORDS.findall(text)]


def _raw(have: list[str]) -> bytes:
    """The bytes that are compressed: words alone, so that signs and indents between lines take none."""
    return " ".join(have).encode("utf-8", "surrogatepass")


class Scanner:
    """All templates as dictionaries, made once in a task."""

    def __init__(self, templates: list[tuple[str, str, float]]):
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.items = []  # name, words that may differ, words, compressor, bytes that a block must save
        for name, text, differ in sorted(templates):
            want = words(text)
            d = zstandard.ZstdCompressionDict(_raw(want), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)
            whole = len(self.alone.compress(_raw(want))) - len(c.compress(_raw(want)))
            self.items.append((name, int(differ * len(want)), want, c, whole if not int(differ * len(want)) else whole * LEAST))
        self.places: dict[str, list[tuple[int, int]]] = {}  # word -> (template, its place there)
        for i, item in enumerate(self.items):
            for p, w in enumerate(item[2]):
                self.places.setdefault(w, []).append((i, p))
        self.known: dict[tuple[bytes, int], tuple[int, int]] = {}

    def reduced(self, block: list[str], number: int) -> tuple[int, int]:
        """(bytes saved, bytes alone) of a block with a template."""
        raw = _raw(block)
        if (got := self.known.get((raw, number))) is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            own = len(self.alone.compress(raw))
            got = self.known[raw, number] = (own - len(self.items[number][3].compress(raw)), own)
        return got

    def ranked(self, have: list[str], at: int) -> list[tuple[int, int, int, int, float]]:
        """(bytes saved, template, first and end word of the block, share saved) of all blocks around word number `at` that save enough, the greatest first."""
        blocks = set()
        for i, p in self.places.get(have[at], ()):
            _, more, want, *_ = self.items[i]
            n, lo = len(want), at - p
            if more:  # the word may be another than the template's at this place: also as far as the template reaches to both sides
                blocks |= {(i, max(0, lo - more), lo + n + more), (i, max(0, at - n - more), at + n + more + 1)}
            elif lo >= 0 and lo + n <= len(have):
                blocks.add((i, lo, lo + n))
        out = []
        for i, lo, hi in blocks:
            saved, own = self.reduced(have[lo:hi], i)
            if saved >= self.items[i][4]:
                out.append((saved, i, lo, hi, round(saved / own, 6)))
        return sorted(out, key=lambda x: (-x[0], self.items[x[1]][0], x[1:]))

    def aligned(self, have: list[str], number: int) -> tuple[int, int, int]:
        """(words that differ, first and end of the words that match): words of the template that the block lacks, and words that the block has
        between those that match. Matches at either end that cost more words in between than they bring are left out, so a notice inside a long line is measured alone."""
        want = self.items[number][2]
        if have == want:
            return 0, 0, len(want)
        m = [x for x in SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if x.size]
        while len(m) > 1 and m[1].a - m[0].a - m[0].size > m[0].size:
            m.pop(0)
        while len(m) > 1 and m[-1].a - m[-2].a - m[-2].size > m[-1].size:
            m.pop()
        if not m:
            return len(want), 0, 0
        same, end = sum(x.size for x in m), m[-1].a + m[-1].size
        return len(want) - same + (end - m[0].a - same), m[0].a, end

    def notice(self, text: str, have: list[str], spans: list[tuple[int, int]], at: int) -> tuple[str, float, int, int, int, int] | None:
        """(license, share saved, words that differ, first and end word, bytes saved) of the notice that holds word number `at`: the first of the ranking with the template's wording."""
        for saved, i, lo, hi, share in self.ranked(have, at):
            name, more, *_ = self.items[i]
            d, a, b = self.aligned(have[lo:hi], i)
            if d <= more and lo + a <= at < lo + b and (more or not _GOES_ON.match(text, spans[lo + b - 1][1])):
                return name, share, d, lo + a, lo + b, saved
        return None

    def scan(self, text: str) -> list[tuple[int, str, float, int, int]]:
        """(line start, license, share saved, words that differ, bytes saved) of each confirmed notice, at the line of its first license word, and (start, '', 0, 0, 0) of the
        candidate lines that begin none."""
        lines: dict[int, list[int]] = {}
        for hit in _pattern().finditer(text):
            lines.setdefault(text.rfind("\n", 0, hit.start()) + 1, []).append(hit.start())
        if not lines:
            return []
        spans = [x.span() for x in _WORDS.finditer(text)]
        firsts, have = [a for a, _ in spans], [text[a:b].lower() for a, b in spans]
        sure: list[list] = []  # start, license, share saved, words that differ, first and end word, bytes saved
        for start, hits in lines.items():
            for hit in hits:
                at = bisect_right(firsts, hit) - 1
                if at >= 0 and not any(x[4] <= at < x[5] for x in sure[-2:]) and (found := self.notice(text, have, spans, at)):
                    _add(sure, [start, *found])
        taken = {x[0] for x in sure}
        return sorted([(*x[:4], x[6]) for x in sure] + [(start, "", 0.0, 0, 0) for start in lines if start not in taken], key=lambda x: x[0])


def _add(sure: list[list], new: list) -> None:
    """new as one more notice; of notices that share words the one that saves most stays, at the first one's line."""
    shared = [x for x in sure[-2:] if x[4] < new[5] and new[4] < x[5]]
    best = max([*shared, new], key=lambda x: x[6])
    if shared:
        sure[:] = [x for x in sure if not any(x is y for y in shared)]
        best = [min(x[0] for x in [*shared, new]), *best[1:]]
    sure.append(best)


def _pattern() -> re.Pattern:
    return re.compile(WORD)


def scan(docs: DataFrame, templates: list[tuple[str, str, float]] | None = None, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_candidates (lines with a license word), n_confirmed (notices), licenses (confirmed names, sorted, comma-joined), license (that of
    the most bytes saved, the first on ties; null if none), saved (the share of its block's bytes) and n_differ (its differing words); with spans the candidates
    themselves. One pass, no shuffle."""
    templates = TEMPLATES if templates is None else templates
    found_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("license", T.StringType()), T.StructField("saved", T.DoubleType()), T.StructField("n_differ", T.LongType())]))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_candidates", T.LongType()), T.StructField("n_confirmed", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("license", T.StringType()), T.StructField("saved", T.DoubleType()), T.StructField("n_differ", T.LongType())]
    fields += [T.StructField("candidates", found_type)] if spans else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                found = scanner.scan(text) if text else []
                sure = [x for x in found if x[1]]
                best = max(sure, key=lambda x: (x[4], -x[0]), default=None)
                rows.append((len({x[0] for x in found}), len(sure), ",".join(sorted({x[1] for x in sure})), best and best[1], best and best[2], best and best[3]) + (([dict(zip(("start", "license", "saved", "n_differ"), x[:4], strict=True)) for x in found],) if spans else ()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("n_differ", pa.int64())]))][: 7 if spans else 6]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[] for _ in kinds], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[f.name for f in fields])

    return docs.select("doc_id", F.when(F.col("text").rlike(WORD), F.col("text")).alias("text")).mapInArrow(run, T.StructType(fields))
