"""License texts by conditional compression.

1. Only texts with a cue word go on, as blocks of the words around their cues.
2. A block is compressed alone and once with each template as zstandard's raw
   dictionary. The share of bytes that a template saves ranks the templates.
3. The words of the block and of the best templates are aligned. A template
   with enough equal words in a row and few enough differences between the
   first and the last of them is confirmed; of those, the license is the one
   with the most equal words less differences, then the larger share of its
   template, then the larger saving.
4. Templates of up to `SHORT` words, and one-line notices ("released under"
   and the name of a license, or an SPDX identifier), are confirmed by all
   their words in a row. Comment marks between words do not count.
5. The words before and after a license are looked at again in the same way,
   until nothing more is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.common import map_arrow
from brightwater.llm.license_names import notices

# Cue words, and public license notices.
CUES = (
    r"(?i)licen[sc]e|copyright|\bspdx|permission is hereby|redistribution and use|public domain"
    r"|\b(?:released|distributed|available|published|provided|offered)(?:\s+to\s+you)?\s+under\b|creative commons|general public"
)
TEMPLATES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words of a block before and after a cue, and in a block at most.
BEFORE, AFTER = 30, 60
BLOCK, OVERLAP = 600, 150
#: Bytes that a template must save to be looked at.
LEAST_SAVED = 12
#: Equal words in a row, and differences per equal word, of a license.
LEAST_EQUAL = 6
MOST_DIFFERENCES = 0.15
#: Words of a template that is confirmed by all of them only.
SHORT = 15

_LEVEL = 19
_NOT_IN_WORD = re.compile(r"[^\w.+-]+")


def _plain(words: list[str]) -> list[str]:
    """Words without case and outer punctuation, one for each."""
    return [_NOT_IN_WORD.sub("", w).strip(".-_").lower() for w in words]


class Scanner:
    def __init__(self, templates: dict[str, str], with_notices: bool = True):
        self.with_notices = with_notices
        self.cue = re.compile(CUES)
        self.alone = zstandard.ZstdCompressor(level=_LEVEL)
        self.templates = {}
        for name, text in templates.items():
            words = _plain(text.split())
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates[name] = words, zstandard.ZstdCompressor(level=_LEVEL, dict_data=raw)

    def blocks(self, text: str) -> list[tuple[int, list[str]]]:
        """Words around cues, with the number of the first; long blocks in overlapping parts."""
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        begins = [a for a, _ in at]
        spans: list[list[int]] = []
        for cue in self.cue.finditer(text):
            k = bisect_right(begins, cue.start()) - 1
            low, high = max(0, k - BEFORE), min(len(at), k + AFTER)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        out = []
        for low, high in spans:
            for begin in range(low, max(low + 1, high - OVERLAP), BLOCK - OVERLAP):
                out.append((begin, [text[a:b] for a, b in at[begin : min(high, begin + BLOCK)]]))
        return out

    def ranked(self, words: list[str]) -> list[tuple[float, str]]:
        """Savings of the templates, best first; equal ones by name."""
        data = " ".join(words).encode()
        size = len(self.alone.compress(data))
        saved = [(size - len(packer.compress(data)), name) for name, (template, packer) in self.templates.items() if len(template) > SHORT]
        return sorted(((n / size, name) for n, name in saved if n >= LEAST_SAVED), key=lambda s: (-s[0], s[1]))

    def confirmed(self, words: list[str], name: str) -> tuple[int, int, int, int] | None:
        """Equal words, first word, number of words and differences of the license in the block."""
        template = self.templates[name][0]
        same = [m for m in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if m.size]
        best = None
        # from each run of equal words, as far as few enough differences allow
        for i, first in enumerate(same):
            if first.size < LEAST_EQUAL:
                continue
            equal = differences = 0
            end_a, end_b = first.a, first.b
            for m in same[i:]:
                differences += max(m.a - end_a, m.b - end_b)
                equal += m.size
                end_a, end_b = m.a + m.size, m.b + m.size
                if differences <= MOST_DIFFERENCES * equal and (best is None or equal > best[0]):
                    best = equal, first.a, end_a - first.a, differences
        return best

    def whole(self, plain: list[str]) -> list[tuple[str, int, int]]:
        """Name, first word and end of one-line notices and of short templates with all their words."""
        at = [i for i, w in enumerate(plain) if w]
        words = [plain[i] for i in at]
        out = list(notices(plain)) if self.with_notices else []
        for name, (template, _) in self.templates.items():
            n = len(template)
            if n <= SHORT:
                out += [(name, at[i], at[i + n - 1] + 1) for i in range(len(words) - n + 1) if words[i] == template[0] and words[i : i + n] == template]
        return out

    def saving(self, data: bytes, words: list[str]) -> float:
        """Share of the bytes of a block that `words` save as its dictionary."""
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = len(self.alone.compress(data))
        return (size - len(zstandard.ZstdCompressor(level=_LEVEL, dict_data=raw).compress(data))) / size

    def best(self, plain: list[str], whole: list[tuple[str, int, int]], low: int, high: int) -> tuple | None:
        """Score, name, first word, end, differences and saving of the best license between two words of a block."""
        part = plain[low:high]
        found = []
        if len(part) >= LEAST_EQUAL:
            for saving, name in self.ranked(part):
                span = self.confirmed(part, name)
                if span is not None:
                    equal, first, n, differences = span
                    score = equal - differences, equal / len(self.templates[name][0])
                    found.append((*score, saving, name, low + first, low + first + n, differences))
        top = max(found, key=lambda f: f[:3], default=None)
        one_line = [(sum(map(bool, plain[a:b])), name, a, b) for name, a, b in whole if low <= a and b <= high]
        equal, name, a, b = max(one_line, key=lambda f: f[0], default=(0, None, 0, 0))
        if name is not None and (top is None or equal > top[0]):
            return equal, name, a, b, 0, self.saving(" ".join(part).encode(), [w for w in plain[a:b] if w])
        return top and (top[0], top[3], top[4], top[5], top[6], top[2])

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        found = []
        for begin, words in self.blocks(text):
            plain = _plain(words)
            whole = self.whole(plain)
            left = [(0, len(plain))]
            while left:
                low, high = left.pop()
                best = self.best(plain, whole, low, high)
                if best is None:
                    continue
                score, name, start, end, differences, saving = best
                left += [(a, b) for a, b in ((low, start), (end, high)) if a < b]
                # parts of a long block overlap: of what both show, the better one stays
                meets = [f for f in found if f[2] < begin + end and begin + start < f[2] + f[3]]
                if all(score > f[0] for f in meets):
                    found = [f for f in found if f not in meets]
                    found.append((score, name, begin + start, end - start, differences, saving))
        return [f[1:] for f in sorted(found, key=lambda f: f[2])]


_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("license", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("differences", pa.int64()), ("saving", pa.float64())]
)


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Columns `doc_id`, `license`, `start_word` (from 0), `n_words`, `differences` and `saving`; a row per license found.

    One-line notices are looked for unless `templates` are given. Null and empty texts and those without a cue word have no row. A text may
    hold several licenses, or one more than once. Null ids are reported with
    it, repeated rows repeatedly. A notice with more differences than allowed is
    found in the parts that have few enough. An empty table gives no rows. Other columns
    are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(CUES))
    given = TEMPLATES if templates is None else templates

    def per_batch(batches):
        scanner = Scanner(given, with_notices=templates is None)
        for batch in batches:
            out = {f.name: [] for f in _FOUND}
            for number, content in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for row in scanner.scan(content.as_py()):
                    for name, value in zip(out, (number, *row)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_FOUND)

    return map_arrow(rows, per_batch, "doc_id bigint, license string, start_word bigint, n_words bigint, differences bigint, saving double")
