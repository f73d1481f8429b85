from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from brightwater.llm import license_scan
from brightwater.llm.queries import QUERIES

APACHE = "Licensed under the Apache License, Version 2.0."
#: The license lines of the table.
LINES = {
    "Apache-2.0": APACHE,
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def test_finds_each_planted_line_of_the_whole_table(spark):
    data = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op8_license_scan"](spark, data).collect()
    for name, line in LINES.items():
        planted = {d for d, t in texts.items() if line in t}
        assert len(planted) > 50
        assert {r["doc_id"] for r in rows if r["license"] == name} == planted
    assert {r["license"] for r in rows} == set(LINES)
    for r in rows:
        assert " ".join(texts[r["doc_id"]].split()[r["start_word"] :][: r["n_words"]]) == LINES[r["license"]]


def test_templates_whole_wrapped_and_edited(spark):
    draw = random.Random(4)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, expected = [], {}
    for i in range(90):
        name = draw.choice(list(license_scan.TEMPLATES))
        words = license_scan.TEMPLATES[name].split()
        if i % 3 == 1:
            words = [w + ("\n# " if k % 9 == 8 else "") for k, w in enumerate(words)]
        if i % 3 == 2 and len(words) > 30:
            words[draw.choice([k for k in range(10, 20) if not re.search(license_scan.CUES, words[k])])] = "changed"
        rows.append((i, f"{prose(draw.randint(0, 100))} {' '.join(words)} {prose(draw.randint(0, 100))}"))
        expected[i] = name
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in license_scan.find_licenses(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {i: {name} for i, name in expected.items()}


def test_cues_alone_are_no_license(spark):
    texts = ["He has a license to drive under the bridge.", "Copyright 2020 by us, all rights reserved in every land.", "license " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert license_scan.find_licenses(docs).collect() == []


def test_odd_rows(spark):
    long = "word " * 50_000 + APACHE
    rows = [(1, None), (2, ""), (None, APACHE), (3, APACHE), (3, APACHE), (4, long), (5, f"{APACHE} {'x ' * 400}{license_scan.TEMPLATES['MPL-2.0']}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("license"))
    got = sorted(((r["doc_id"], r["license"], r["start_word"]) for r in license_scan.find_licenses(docs).collect()), key=str)
    assert got == sorted([(3, "Apache-2.0", 0)] * 2 + [(None, "Apache-2.0", 0), (4, "Apache-2.0", 50_000), (5, "Apache-2.0", 0), (5, "MPL-2.0", 407)], key=str)
    assert license_scan.find_licenses(docs.limit(0)).collect() == []
