"""License scans by conditional compression.

Sentences with a license cue, and what little stands between them, are candidate blocks. A block is compressed alone
and with each template as zstandard's raw dictionary, which ranks the templates by what they save; in long blocks a short
notice saves little, so every template of which the block holds enough words is compared word by word. A finding needs
nearly all words of the template, and says which are missing and which are extra. Unknown wordings with a cue are reported without a license where no template fits.

Only documents with a cue leave the scan, so tasks are independent and nothing is shuffled. Work on a block is linear
in its length: long blocks are compared in overlapping windows of the template's size.

Defined cases: null and empty texts have no findings; repeated rows are documents of their own; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.arrow import slices

# Public license notices and texts, by name.
WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. " + WARRANTY,
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Proprietary": ["All rights reserved."],
}
# Words that make a sentence a candidate.
CUES = r"(?i)licen[sc]|copyright|©|all rights reserved|permission (?:is hereby|to use)|redistribut|free software|source code form|waived all|without warrant|creative commons|public domain|\bspdx"

WORDS = re.compile(r"\w+(?:[.\-/]\w+)*|©")
SENTENCES = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)", re.S)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


def blocks_of(text: str, gap: int = 3) -> list[tuple[int, int]]:
    """(start, end) of runs of sentences from cue to cue, with at most ``gap`` sentences without one in between."""
    cue = re.compile(CUES)
    out: list[list[int]] = []
    plain = gap + 1
    for m in SENTENCES.finditer(text):
        if m.start() == m.end():
            continue
        if not cue.search(m[0]):
            plain += bool(m[0].strip())
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if out and plain <= gap:
            out[-1][1] = m.end()
        else:
            out.append([start, m.end()])
        plain = 0
    return [(a, a + len(text[a:b].rstrip())) for a, b in out]


def behind(text: str, end: int, gap: int = 3) -> int:
    """The end of the ``gap`` sentences behind a block: the last ones of a notice may have no cue."""
    for m in SENTENCES.finditer(text, end):
        if m[0].strip(" \t\r\n.!?"):
            end, gap = m.end(), gap - 1
        if not gap:
            break
    return end


class Sizes:
    """Compressed sizes with and without a template, in frames without any header fields that can be left out."""

    def __init__(self, text: str | None):
        self.shape = zstandard.ZstdCompressionParameters(compression_level=19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = None if text is None else zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coder = zstandard.ZstdCompressor(compression_params=self.shape, dict_data=raw) if raw else zstandard.ZstdCompressor(compression_params=self.shape)

    def __call__(self, block: str) -> int:
        return len(self.coder.compress(block.lower().encode()))


@cache
def templates() -> list[tuple[str, str, list[str], Sizes]]:
    return [(name, text, words_of(text), Sizes(text)) for name, texts in TEMPLATES.items() for text in texts]


@cache
def alone() -> Sizes:
    return Sizes(None)


def rank(block: str) -> list[tuple[float, int]]:
    """(size reduction, template), the largest reduction first."""
    plain = alone()(block)
    return sorted(((1 - size(block) / plain, -i) for i, (_, _, _, size) in enumerate(templates())), reverse=True)


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
    """(missing words, extra words inside, first, last place) of the best match of the template in the block."""
    n = len(template)
    best = None
    width = 2 * n + 20
    for at in range(0, max(1, len(block) - n // 2), n + 10):
        part = block[at : at + width]
        pieces = [m for m in SequenceMatcher(None, part, template, autojunk=False).get_matching_blocks() if m.size]
        if not pieces:
            continue
        first, last = pieces[0].a, pieces[-1].a + pieces[-1].size
        found = sum(m.size for m in pieces)
        score = found - 0.5 * (last - first - found)
        if best is None or score > best[0]:
            missing = Counter(template) - Counter(template[i] for m in pieces for i in range(m.b, m.b + m.size))
            inside = [i for i in range(first, last) if not any(m.a <= i < m.a + m.size for m in pieces)]
            best = score, sorted(missing.elements()), [part[i] for i in inside], at + first, at + last
    return best[1:] if best else (template, [], 0, 0)


def scan(text: str | None, tolerance: float = 0.1) -> list[dict]:
    """Findings of a text: license, start, end, reduction, missing and extra words.

    The template with fewest differences wins, the longer one among equals, then the one that saves more; it may miss
    ``tolerance`` of its words and hold as many extra ones. The block is searched on before and behind it;
    where nothing fits up to the end of the block, some sentences behind it are taken in.
    """
    out, cue = [], re.compile(CUES)
    for start, end in blocks_of(text or ""):
        spans = [(m.start() + start, m.end() + start) for m in WORDS.finditer(text[start : behind(text, end)])]
        inside = sum(a < end for a, _ in spans)
        words = [text[a:b].lower() for a, b in spans]
        found, ranges = [], [(0, inside)] if inside else []
        while ranges:
            lo, hi = ranges.pop()
            best, held = None, Counter(words[lo:hi])
            for saved, i in rank(text[spans[lo][0] : spans[hi - 1][1]]):
                name, _, template, _ = templates()[-i]
                if (Counter(template) - held).total() > tolerance * len(template):
                    continue  # more would be missing in any place
                missing, extra, first, last = differences(words[lo:hi], template)
                if last > first and len(missing) <= tolerance * len(template) and len(extra) <= tolerance * len(template):
                    order = (len(missing) + len(extra), -len(template), -saved, i)
                    if best is None or order < best[0]:
                        best = order, name, saved, missing, extra, lo + first, lo + last
            if best is None:
                if hi == inside < len(spans):
                    ranges.append((lo, len(spans)))
                continue
            _, name, saved, missing, extra, first, last = best
            found.append({"license": name, "start": spans[first][0], "end": spans[last - 1][1], "reduction": saved, "missing": missing, "extra": extra})
            ranges += [(x, y) for x, y in ((lo, first), (last, hi)) if x < y and cue.search(text[spans[x][0] : spans[y - 1][1]])]
        if not found:
            found = [{"license": None, "start": start, "end": end, "reduction": rank(text[start:end])[0][0], "missing": [], "extra": []}]
        out += sorted(found, key=lambda f: f["start"])
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, start, end, reduction, missing, extra): a row for each finding, places in characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["license", "start", "end", "reduction", "missing", "extra"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        for batch in slices(batches, "text"):
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for found in scan(text):
                    at.append(i)
                    rows.append(found)
            cols = [batch.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names])

    ddl = f"doc_id {kind}, license string, start long, end long, reduction double, missing array<string>, extra array<string>"
    return docs.select("doc_id", "text").filter(F.col("text").rlike(CUES)).mapInArrow(run, ddl)
