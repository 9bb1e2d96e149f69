"""License scans by conditional compression.

A block is a run of sentences that speak of licensing. It is compressed alone and
with each template as a raw zstandard dictionary, by itself and with what surrounds
it; the templates that spare bytes are its candidates. A candidate is confirmed on
its wording: the words of template and text are aligned, words that are missing or
other are counted, and the words that tell the license from its relatives (its own
name, its version, a clause's wording) must all be there. What is confirmed is cut
out, and what is left is looked through again until nothing is confirmed.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from semcat.llm.rows import with_arrays

# stems that a sentence about licensing holds
CUES = ("licen", "copyright", "permission", "warrant", "redistribut", "public domain", "spdx")
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)")
_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
# share of a template's words that must be found in order
AGREEMENT = 0.8
# sentences without a cue that may stand within a block
GAP = 1
# a text may be so much longer than its template, in words and characters
SLACK = 1.5
SPARE_WORDS = 8
SPARE_CHARS = 64
# lines above a license that belong to it
_TITLE = ("the", "a", "license", "clause", "simplified", "new", "revised", "modified", "expat", "c", "apache", "version", "header")
_NOTICE = re.compile(r"\W*(?:copyright\b|\(c\)|©|all rights reserved)", re.I)


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    names: tuple[str, ...]  # words that must all be there


def template(name: str, names: str, text: str) -> Template:
    return Template(name, text, tuple(names.split()))


# Short notices of well-known public licenses.
TEMPLATES = (
    template("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    template("MIT", "mit", "Released under the MIT License."),
    template("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    template("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    template("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    template("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    template("MPL-2.0", "mozilla 2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    template("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    template("BSD-2-Clause", "bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    template("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    template("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    template("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    template("CC-BY-ND-4.0", "cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    template("CC0-1.0", "cc0 1.0", "Dedicated to the public domain under CC0 1.0."),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so"""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(kind: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}
    Public License as published by the Free Software Foundation, either version {version} of the License, or (at your
    option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
    without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public
    License for more details. You should have received a copy of the GNU {kind} Public License along with this program.
    If not, see <https://www.gnu.org/licenses/>."""


# Bodies and standard headers. What must be there is wording that near relatives lack.
BODIES = (
    template("MIT", "hereby sublicense included", f"""{_MIT_GRANT}, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. {_MIT_END}"""),
    template("MIT-0", "hereby sublicense", f"{_MIT_GRANT}. {_MIT_END}"),
    template("ISC", "fee provided appear", f"""{_ISC_GRANT}, provided that the above copyright notice and this permission
        notice appear in all copies. {_ISC_END}"""),
    template("0BSD", "fee", f"{_ISC_GRANT}. {_ISC_END}"),
    template("BSD-2-Clause", "redistributions retain reproduce", f"{_BSD_TWO} {_BSD_END}"),
    template("BSD-3-Clause", "redistributions retain reproduce neither endorse", f"{_BSD_TWO} 3. {_BSD_NAME} {_BSD_END}"),
    template("BSD-4-Clause", "redistributions retain reproduce advertising neither endorse", f"""{_BSD_TWO} 3. All
        advertising materials mentioning features or use of this software must display the following acknowledgement:
        This product includes software developed by the organization. 4. {_BSD_NAME} {_BSD_END}"""),
    template("Apache-2.0", "apache 2.0 compliance", """Licensed under the Apache License, Version 2.0 (the "License"); you
        may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under
        the License."""),
    template("GPL-3.0", "gnu general 3", _gnu("General", "3")),
    template("GPL-2.0", "gnu general 2", _gnu("General", "2")),
    template("LGPL-3.0", "gnu lesser 3", _gnu("Lesser General", "3")),
    template("LGPL-2.1", "gnu lesser 2.1", _gnu("Lesser General", "2.1")),
    template("AGPL-3.0", "gnu affero 3", _gnu("Affero General", "3")),
    template("MPL-2.0", "mozilla 2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v.
        2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
)
TEMPLATES += BODIES


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str, taken: list[tuple[int, int]] = []) -> list[tuple[int, int]]:
    """(start, end) of the runs of sentences that speak of licensing; those that overlap ``taken`` (sorted) end a run."""
    found: list[list[int]] = []
    if not any(cue in text.lower() for cue in CUES):
        return []
    since = GAP + 1
    for m in _SENTENCE.finditer(text):
        if m.start() == m.end():
            continue
        at = bisect.bisect_right(taken, m.start(), key=lambda x: x[1])
        if at < len(taken) and taken[at][0] < m.end():
            since = GAP + 1
            continue
        sentence = m.group().lower()
        if any(cue in sentence for cue in CUES):
            if found and since <= GAP:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
            since = 0
        else:
            since += 1
    return [(a, b) for a, b in found]


class Scanner:
    """Compressors with each template as dictionary, and their confirmation."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        # a raw dictionary is content alone, without tables of its own
        self.given = [
            zstandard.ZstdCompressor(
                level=3,
                write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(
                    _padded(t.text.lower()), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
            )
            for t in templates
        ]
        self.words = [_words(t.text) for t in templates]
        self.counts = [Counter(w) for w in self.words]
        # a license's text may go so far beyond a sentence that speaks of licensing
        cue = re.compile("|".join(map(re.escape, CUES)))
        apart = []
        for t in templates:
            at = [0, *(m.start() for m in cue.finditer(t.text.lower())), len(t.text)]
            apart += [y - x for x, y in zip(at, at[1:])]
        self.reach = int(SLACK * max(apart, default=0)) + SPARE_CHARS

    def spared(self, data: str) -> set[int]:
        """The templates that spare bytes."""
        data = data.lower().encode("utf-8", "replace")
        alone = len(self.alone.compress(data))
        return {i for i, c in enumerate(self.given) if len(c.compress(data)) < alone}

    def stretches(self, text: str, found: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """(start, end, blocks): blocks with what surrounds them, joined where they are in reach."""
        out: list[tuple[int, int, list]] = []
        for a, b in found:
            low, high = max(0, a - self.reach), min(len(text), b + self.reach)
            if out and low < out[-1][1]:
                out[-1] = (out[-1][0], high, [*out[-1][2], (a, b)])
            else:
                out.append((low, high, [(a, b)]))
        return out

    def confirmed(self, there: list[str], number: int) -> list[tuple[int, int, int, int, int]]:
        """(worth, start, end, missing, other) of the places in ``there`` that hold a template's wording."""
        wanted, names = self.words[number], set(self.templates[number].names)
        n, out = len(wanted), {}
        if not n:
            return []
        if names:
            counts = Counter(w for w in there if w in names)
            if len(counts) < len(names):
                return []
            # every place holds this word
            rare = min(sorted(names), key=counts.__getitem__)
            own = [q for q, w in enumerate(wanted) if w == rare] or [0, n]
            reach = [int(SLACK * max(own)) + SPARE_WORDS, int(SLACK * (n - min(own))) + SPARE_WORDS]
            windows = [(max(0, p - reach[0]), p + reach[1]) for p, w in enumerate(there) if w == rare]
        else:
            windows = [(0, len(there))]
        for low, high in windows:
            part = there[low:high]
            if (self.counts[number] & Counter(part)).total() < AGREEMENT * n:
                continue
            same = [m for m in difflib.SequenceMatcher(None, wanted, part, autojunk=False).get_matching_blocks() if m.size]
            # words far off at either end are others' words
            while len(same) > 1 and same[1].b - same[0].b - same[0].size > same[0].size:
                del same[0]
            while len(same) > 1 and same[-1].b - same[-2].b - same[-2].size > same[-1].size:
                del same[-1]
            agreed = sum(m.size for m in same)
            if agreed < AGREEMENT * n:
                continue
            start, end = same[0].b, same[-1].b + same[-1].size
            if names <= set(part[start:end]):
                missing, other = n - agreed, end - start - agreed
                out[low + start, low + end] = (agreed - missing - other, low + start, low + end, missing, other)
        return list(out.values())

    def within(self, text: str, a: int, b: int, inner: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(start, end, template, missing, other) of all licenses in a stretch, until nothing is confirmed in what is left."""
        found, left = [], [(a, b)]
        while left:
            a, b = left.pop()
            words = [(m.group(), a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b].lower())]
            there = [w for w, _, _ in words]
            likely = self.spared(text[a:b])
            # in a long stretch a short notice hardly shows
            for x, y in inner:
                if a < y and x < b:
                    likely |= self.spared(text[max(a, x) : min(b, y)])
            sure = [(-worth, number, *rest) for number in sorted(likely) for worth, *rest in self.confirmed(there, number)]
            taken: list[tuple[int, int]] = []
            for _, number, start, end, missing, other in sorted(sure):
                at = bisect.bisect_right(taken, start, key=lambda x: x[1])
                if at == len(taken) or taken[at][0] >= end:
                    taken.insert(at, (start, end))
                    found.append((words[start][1], words[end - 1][2], number, missing, other))
            if taken:
                ends = [a, *(p for x, y in taken for p in (words[x][1], words[y - 1][2])), b]
                left += [(x, y) for x, y in zip(ends[::2], ends[1::2]) if x < y]
        return found

    def begun(self, text: str, start: int, number: int) -> int:
        """Where the lines above a license begin that are blank, its title or a copyright notice."""
        title = {*_words(self.templates[number].name), *_words(self.templates[number].name.replace("-", " ")), *_TITLE}
        line = text.rfind("\n", 0, start) + 1
        if _WORD.search(text, line, start):
            return start
        first = start
        while line:
            above = text.rfind("\n", 0, line - 1) + 1
            words = _words(text[above : line - 1])
            if words and not set(words) <= title and not _NOTICE.match(text, above, line - 1):
                break
            first, line = (above if words else first), above
        return first

    def scan(self, text: str) -> list[dict]:
        found, taken = [], []
        for a, b, inner in self.stretches(text, blocks(text)):
            for start, end, number, missing, other in sorted(self.within(text, a, b, inner)):
                start = max(self.begun(text, start, number), taken[-1][1] if taken else 0)
                taken.append((start, end))
                found.append(
                    {"license": self.templates[number].name, "start": start, "end": end, "missing": missing, "other": other}
                )
        found += [
            {"license": None, "start": a, "end": b, "missing": None, "other": None} for a, b in blocks(text, taken)
        ]
        return sorted(found, key=lambda x: x["start"])


def _padded(text: str) -> bytes:
    """A dictionary of at least eight bytes, below which the library takes none."""
    return text.encode().ljust(8)


FOUND = T.ArrayType(
    T.StructType()
    .add("license", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("missing", T.IntegerType())
    .add("other", T.IntegerType())
)


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with ``licenses``: one entry per license confirmed or block without one, in the text's order.

    An entry has the license (null for sentences that speak of licensing but are
    part of no confirmed one), its place in characters (with its title and copyright
    lines), and how many words are missing or other. Null and empty
    texts have no block. A column of that name is replaced, all others are kept.
    """
    made: list[Scanner] = []
    kind = pa.list_(
        pa.struct([("license", pa.string()), *[(n, pa.int32()) for n in ("start", "end", "missing", "other")]])
    )

    def run(column: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Scanner(templates))
        # texts repeat: equal ones of a batch are scanned once
        coded = column.dictionary_encode()
        each = [made[0].scan(x or "") for x in coded.dictionary.to_pylist()]
        index = coded.indices.to_pylist()
        return [pa.array([each[i] if i is not None else [] for i in index], kind)]

    return with_arrays(docs, text_col, {"licenses": FOUND}, run)
