from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brightwater.llm.window_dedup import remove_repeated_windows


def brute(rows, width=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1 if d is not None else 0):
            key = tuple(w[i : i + width])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force_on_whole_table(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(remove_repeated_windows(docs.repartition(parts))) == expected
    assert sum(row[2] for row in expected) > 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_few_words_make_many_repeats(spark, seed):
    """Windows repeat within and between documents, ids repeat and are null."""
    draw = random.Random(seed)
    passages = [[draw.choice("abc") for _ in range(draw.randint(1, 30))] for _ in range(6)]
    rows = [
        (draw.choice([None, *range(40)]), " ".join(sum(draw.choices(passages, k=draw.randint(0, 5)), []))) for _ in range(80)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(remove_repeated_windows(docs.repartition(4))) == brute(rows)
    assert result(remove_repeated_windows(docs.repartition(3), width=4, minimizer=2)) == brute(rows, 4)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (9, long), (3, long + " end"), (4, None), (5, ""), (6, " \t\n "), (None, long), (7, "é x  y\u0085z"),
        (3, "other text"), (8, "a " * 12), (10, "a " * 13), (11, "a " * 14),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("mark"), F.lit("k").alias("runs"))
    assert result(remove_repeated_windows(docs)) == brute(rows)


def test_many_copies(spark):
    """A group of copies over many slices and batches of sorted rows."""
    draw = random.Random(4)
    text = " ".join(str(draw.randrange(1000)) for _ in range(40))
    rows = [(i, text if i % 3 else f"{text} {i}") for i in range(5000)]
    got = result(remove_repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)))
    assert sum(row[2] for row in got) == 4999 * 40
    assert got == brute(rows)


def test_empty_table(spark):
    assert result(remove_repeated_windows(spark.createDataFrame([], "doc_id bigint, text string"))) == []
