"""Operator 1: license scans by conditional compression.

A line that mentions a licence and the lines around it, up to a blank one, are
a candidate block; blocks with nothing but blank lines between them are one.
A block is compressed alone and with each template as a raw zstandard
dictionary.  Templates are ranked by what they save, and the first whose exact
wording the block has, but for few differences, is confirmed: the words that
tell one licence from another must stand as they are.  What the wording leaves
of the block on either side is a block again, so that notices in a row are all
found.  Words alone are compared, so wrapping and comment signs don't matter.
"""

from __future__ import annotations

import bisect
import collections
import difflib
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Wordings of public licence notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "it under the terms of the GNU {0}General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
_GNU_AS_IS = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
_GPL_3 = "This program is free software: you can redistribute it and/or modify " + _GNU.format("", ",", "3")
_GPL_2 = "This program is free software; you can redistribute it and/or modify " + _GNU.format("", ";", "2")
_LGPL_3 = "This library is free software: you can redistribute it and/or modify " + _GNU.format("Lesser ", ",", "3")
_LGPL_2 = "This library is free software; you can redistribute it and/or modify " + _GNU.format("Lesser ", ";", "2.1")
_AGPL_3 = "This program is free software: you can redistribute it and/or modify " + _GNU.format("Affero ", ",", "3")
_SHORT_GNU = "This work is licensed under the GNU {0}General Public License, version {1}."
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_AS_IS}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, f"{_APACHE} {_APACHE_AS_IS}"],
    "GPL-3.0": [_SHORT_GNU.format("", "3"), _GPL_3, f"{_GPL_3} {_GNU_AS_IS.format('program', '')}"],
    "GPL-2.0": [_SHORT_GNU.format("", "2"), _GPL_2, f"{_GPL_2} {_GNU_AS_IS.format('program', '')}"],
    "LGPL-3.0": [_SHORT_GNU.format("Lesser ", "3"), _LGPL_3, f"{_LGPL_3} {_GNU_AS_IS.format('library', 'Lesser ')}"],
    "LGPL-2.1": [_SHORT_GNU.format("Lesser ", "2.1"), _LGPL_2, f"{_LGPL_2} {_GNU_AS_IS.format('library', 'Lesser ')}"],
    "AGPL-3.0": [_SHORT_GNU.format("Affero ", "3"), _AGPL_3, f"{_AGPL_3} {_GNU_AS_IS.format('program', 'Affero ')}"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [_BSD, f"{_BSD} {_BSD_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_THIRD}", f"{_BSD} {_BSD_THIRD} {_BSD_AS_IS}"],
    "ISC": [_ISC, f"{_ISC} {_ISC_AS_IS}"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("Attribution")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial")],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "proprietary": ["All rights reserved."],
}
# Runs of words that a wording must have as they stand, if its template has them.
TELLING = (
    "mit license", "apache license version 2.0", "gnu general public license", "gnu lesser general public license", "gnu affero general public license", "license version 2", "license version 2.1", "license version 3",
    "either version 2", "either version 2.1", "either version 3", "mozilla public license v 2.0", "neither the name", "boost software license version 1.0", "cc by 4.0", "cc by-sa 4.0", "cc by-nc 4.0",
    "creative commons attribution 4.0", "creative commons attribution-sharealike 4.0", "creative commons attribution-noncommercial 4.0", "all rights reserved", "public domain", "waived all copyright", "free of charge",
    "redistributions in binary form", "with or without fee",
)
# Words that make a line a candidate.
CUES = ("licen", "copyright", "all rights reserved", "redistribut", "permission", "public domain", "free software", "apache", "creative commons", "warrant", "as is")

#: Words that may differ, as a share of the template; words of a window of a
#: long block and its step: a template with its differences fits the overlap.
MAX_DIFFERENCE, WINDOW, STEP = 0.2, 800, 400
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def holds(words: list[str], run: list[str]) -> bool:
    return any(words[i : i + len(run)] == run for i in range(len(words) - len(run) + 1))


class Template:
    def __init__(self, name: str, text: str) -> None:
        import zstandard

        self.name, self.words = name, words_of(text)
        self.counts = collections.Counter(self.words)
        self.telling = [run for run in map(words_of, TELLING) if holds(self.words, run)]
        content = zstandard.ZstdCompressionDict((" ".join(self.words) + "\n").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, block: bytes) -> int:
        return len(self.compressor.compress(block))


@functools.cache
def templates() -> tuple[list[Template], object]:
    """All templates, and the compressor without one."""
    import zstandard

    return [Template(name, text) for name, texts in TEMPLATES.items() for text in texts], zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False)


def lowered(text: str) -> str:
    """In lower case, character for character; a dotted capital I alone would become two."""
    return text.replace("\u0130", "i").lower()


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidate blocks; long ones are cut into overlapping windows
    of words, of which those with a cue count."""
    lower = lowered(text)
    if not any(cue in lower for cue in CUES):
        return []
    blocks: list[list[int]] = []  # start, end, whether there is a cue
    at, open_block = 0, False
    for line in lower.split("\n"):
        end, blank = at + len(line), not _WORD.search(line)
        if not blank:
            cue = any(c in line for c in CUES)
            if open_block:
                blocks[-1][1:] = [end, blocks[-1][2] or cue]
            else:
                blocks.append([at, end, cue])
        open_block, at = not blank, end + 1
    runs: list[list[int]] = []
    for i, (a, b, cue) in enumerate(blocks):
        if cue:
            if runs and runs[-1][2] == i - 1:
                runs[-1][1:] = [b, i]
            else:
                runs.append([a, b, i])
    out = []
    for a, b, _ in runs:
        starts = [m.start() for m in re.finditer(r"\S+", text[a:b])]
        windows = [(a, b)]
        if len(starts) > WINDOW:
            windows = [(a + starts[i], a + starts[i + WINDOW] if i + WINDOW < len(starts) else b) for i in range(0, len(starts) - STEP, STEP)]
        out += [w for w in windows if any(cue in lower[w[0] : w[1]] for cue in CUES)]
    return out


def differences(block: list[str], template: list[str]) -> tuple[int, int, int]:
    """Words of the template that the block lacks, plus foreign words between
    those it has; and where in the block the wording begins and ends.  Of the
    runs of words that they share, those in a row that make this least."""
    runs = [m for m in difflib.SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    best, gain, start, end = (0, 0, 0), 0, 0, 0
    for m in runs:
        # a run on which nothing before it pays begins anew
        if (carried := gain - (m.a - end)) <= 0:
            carried, start = 0, m.a
        gain, end = carried + m.size, m.a + m.size
        if gain > best[0]:
            best = (gain, start, end)
    return len(template) - best[0], best[1], best[2]


def confirmed(text: str, a: int, b: int) -> tuple[str, int, int, int, float] | None:
    """(license, start, end, differing words, share of the size saved) of the
    template that a block is confirmed for, if any: the one that saves most
    of those whose wording the block has."""
    known, plain = templates()
    tokens = list(_WORD.finditer(text[a:b]))
    words = [m[0].lower() for m in tokens]
    counts = collections.Counter(words)
    # words that the block has too seldom differ in any case
    able = [t for t in known if sum((t.counts - counts).values()) <= MAX_DIFFERENCE * len(t.words)]
    if not able:
        return None
    block = " ".join(words).encode("utf-8", "surrogatepass")
    alone = len(plain.compress(block))
    for size, _, template in sorted((t.size(block), i, t) for i, t in enumerate(able)):
        n, first, last = differences(words, template.words)
        if n <= MAX_DIFFERENCE * len(template.words) and all(holds(words[first:last], run) for run in template.telling):
            return template.name, a + tokens[first].start(), a + tokens[last - 1].end(), n, 1 - size / alone
    return None


def matches(text: str) -> list[tuple[str, int, int, int, float]]:
    """The confirmed wordings of a text in order; of overlapping ones the
    longest counts, and of these the one that differs least."""
    found, todo, lower = [], candidates(text), lowered(text)
    while todo:
        a, b = todo.pop()
        if match := confirmed(text, a, b):
            found.append(match)
            todo += [(x, y) for x, y in ((a, match[1]), (match[2], b)) if any(cue in lower[x:y] for cue in CUES)]
    kept: list[tuple[int, int, tuple]] = []  # by start, none overlapping
    for match in sorted(set(found), key=lambda m: (m[1] - m[2], m[3], m)):
        at = bisect.bisect(kept, (match[1], match[2]))
        if (at == 0 or kept[at - 1][1] <= match[1]) and (at == len(kept) or match[2] <= kept[at][0]):
            kept.insert(at, (match[1], match[2], match))
    return [k[2] for k in kept]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, licenses, matches of every document.

    ``licenses`` are the distinct names, sorted and comma-joined; ``matches``
    is an array of (license, start, end, differing, saved), offsets in code
    points.  A null or empty text has neither; repeated rows and null ids
    pass through; other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("differing", pa.int64()), ("saved", pa.float64())]))

    def rows(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [matches(t) for t in texts]
            named = [[dict(zip(("license", "start", "end", "differing", "saved"), m, strict=True)) for m in ms] for ms in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(candidates(t)) for t in texts], pa.int64()), pa.array([",".join(sorted({m[0] for m in ms})) for ms in found], pa.string()), pa.array(named, kind)],
                names=["doc_id", "n_candidates", "licenses", "matches"],
            )

    schema = "doc_id long, n_candidates long, licenses string, matches array<struct<license string, start long, end long, differing long, saved double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
