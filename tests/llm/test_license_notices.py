from __future__ import annotations

import re

from brightwater.llm import license_scan
from brightwater.llm.license_names import notices
from brightwater.llm.queries import QUERIES

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_all_license_lines_of_the_table(spark):
    data = "/root/testdata/sf0.1"
    expected = []
    for row in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        for line, name in LINES.items():
            for m in re.finditer(re.escape(line), row["text"] or ""):
                expected.append((row["doc_id"], name, len(row["text"][: m.start()].split()), len(line.split()), 0))
    assert len(expected) == 262
    got = [tuple(r)[:5] for r in QUERIES["op8_license_scan"](spark, data).collect()]
    assert sorted(got) == sorted(expected)


def names(text: str) -> list[str]:
    return [r[0] for r in license_scan.Scanner(license_scan.TEMPLATES).scan(text)]


def test_notices_by_wording():
    for text, expected in {
        "Released under the GNU Lesser General Public License v2.1 or later.": ["LGPL-2.1-or-later"],
        "Licensed under version 2 of the GNU General Public License.": ["GPL-2.0-only"],
        "Licensed under GPLv3+": ["GPL-3.0-or-later"],
        "Licensed under the GNU Affero General Public License, version 3, or (at your option) any later version.": ["AGPL-3.0-or-later"],
        "Made available under the GPL.": ["GPL"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
        "Distributed under the 3-clause BSD license": ["BSD-3-Clause"],
        "# Licensed under\n# the MIT\n# License": ["MIT"],
        "// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": ["GPL-2.0-or-later"],
        "Made available under the table, he said under license of version 2.": [],
        "The SPDX-License-Identifier is a tag.": [],
    }.items():
        assert names(text) == expected, text


def test_gnu_wordings_are_told_apart():
    for name in [n for n in license_scan.TEMPLATES if "GPL" in n]:
        assert names(license_scan.TEMPLATES[name]) == [name]


def test_words_that_only_look_like_notices():
    assert notices("licensed under zero conditions and mittens".split()) == []


def test_several_licenses_close_together():
    t = license_scan.TEMPLATES
    assert names(f"{t['MIT']} or else {t['Apache-2.0']}") == ["MIT", "Apache-2.0"]
    assert names("Licensed under the MIT License and the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    # a notices file, each license once more after the others
    order = [n for n in t] * 2
    text = " ".join(f"Part {i}, copyright by maker{i}. {t[n]}" for i, n in enumerate(order))
    rows = license_scan.Scanner(t).scan(text)
    assert [r[0] for r in rows] == order
    words = text.split()
    for (_, start, n, differences, _), name in zip(rows, order):
        assert differences == 0 and words[start : start + n] == t[name].split()


def test_many_one_line_notices_in_one_block():
    lines = list(LINES) * 12
    assert names(" ".join(lines)) == [LINES[line] for line in lines]
