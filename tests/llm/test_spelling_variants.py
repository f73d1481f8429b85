from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brightwater.llm import spelling_variants as variants
from brightwater.llm.queries import QUERIES

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows):
    """rows: (doc_id, text)."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    with_gap = {}
    for w in words:
        for k in range(len(w)):
            with_gap.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for group in with_gap.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_on_whole_table(spark):
    data = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_spelling_variants"](spark, data)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute(rows)
    assert result(got) == expected
    assert sum(r[1] is not None for r in expected) > 1000 and any(r[2] not in (r[0], r[1]) for r in expected)


@pytest.mark.parametrize("often, dictionary, asking", [(2, 10**6, 1), (64, 30, 256), (10**9, 1, 3)])
def test_dense_words(spark, monkeypatch, often, dictionary, asking):
    """Few letters, so that many words are near others, with dictionaries from deep to empty and lists dealt out."""
    monkeypatch.setattr(variants, "OFTEN", often)
    monkeypatch.setattr(variants, "DICTIONARY", dictionary)
    monkeypatch.setattr(variants, "ASKING", asking)
    draw = random.Random(often)
    pool = ["".join(draw.choice("aabéÿ") for _ in range(draw.choice([4, 5, 5, 6, 7, 8, 9, 12]))) for _ in range(500)]
    rows = [(k, " ".join(draw.choices(pool, k=draw.choice([0, 30, 200])))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute(rows)
    assert result(variants.variants(docs)) == expected
    assert sum(r[4] for r in expected) > 300


def test_odd_rows(spark):
    rows = [
        (None, "abcde " * 7 + "abcdf abcdf abcdf"), (None, None), (1, ""), (2, "1234 ... Œuvre Œuvre Œuvre 中文"),
        (3, "ABCDE-Abcde_Étéééé étéééé Étéééé"), (3, "abcde×÷abcde " * 4), (3, "abcde×÷abcde " * 4),
        (4, ("x" * 3_000 + " ") * 3 + ("x" * 2_999 + " ") * 9), (5, "word " * 50_000 + "words " * 40_000), (97, "<abcde> <<abcde abcde>>"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("word"), F.lit(2).alias("n"), F.lit(3).alias("key"))
    assert result(variants.variants(docs)) == brute(rows)
    assert result(variants.variants(docs.limit(0))) == []


def test_lists_are_few_and_short(spark):
    """A word asks for two lists of its own length and two of the next; candidates stay a small part of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = docs.sparkSession.createDataFrame(variants.count_words(docs).collect(), "word string, n bigint")
    sent = spark.sparkContext.broadcast(variants.gram_dictionary(words))
    asked, index = variants._asked(words, sent), variants._index(words, sent)
    assert asked.groupBy("a").count().where("count != 4").isEmpty()
    candidates = asked.join(index, "key").count()
    assert candidates < words.count() ** 2 / 200


def test_a_counter_passes_on_what_it_has(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in variants.count_words(docs).collect()}
    assert got == {r[0]: r[3] for r in brute(rows)}
