from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brightwater.llm import decontamination
from brightwater.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    """Best similarity of any window of the item's length, per document and item."""
    wordings = {}
    for item_id, text in items:
        w = tuple(words(text))
        if len(w) >= 5:
            wordings[w] = min(item_id, wordings.get(w, item_id))
    index = {}
    for w in wordings:
        for g in grams(w):
            index.setdefault(g, set()).add(w)
    out = {}
    for doc_id, text in docs:
        d = words(text)
        g = grams(d)
        for w in set().union(*(index.get(x, ()) for x in g)):
            wanted = Counter(grams(w))
            size = len(w) - 4
            for s in range(max(1, len(g) - size + 1)):
                have = Counter(g[s : s + size])
                shared = sum((have & wanted).values())
                similarity = shared / (have.total() + wanted.total() - shared)
                if similarity >= 0.8 - 1e-12:
                    out[doc_id, wordings[w]] = max(similarity, out.get((doc_id, wordings[w]), 0))
    return out


def test_equals_brute_force_on_whole_table(spark):
    data = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    rows = QUERIES["op2_benchmark_decontamination"](spark, data).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows} == brute(docs, items)
    assert len(rows) > 20


def test_edited_passages(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(draw.randint(5, 90)))) for i in range(30)]
    items += [(40, items[3][1].upper()), (41, "ha " * 30), (42, "one two three four"), (43, None), (44, "")]
    docs = []
    for i in range(150):
        passage = draw.choice(items)[1] or ""
        edited = passage.split()
        if edited and i % 3:
            edited[draw.randrange(len(edited))] = word()
        docs.append((i, " ".join([*(word() for _ in range(draw.randint(0, 40))), *edited, *(word() for _ in range(draw.randint(0, 40)))])))
    docs += [(200, items[0][1].replace(" ", ", ").title()), (201, "ha " * 200), (None, items[1][1]), (202, None), (203, "")]
    docs += [(200, "other words of the same id"), (0, docs[0][1]), (204, "x " * 30_000 + items[2][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", F.lit(1).alias("row_key"), F.lit("a").alias("start"))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("length", F.lit("x"))
    expected = brute(docs, items)
    for limit in (decontamination.BROADCAST_ROWS, 0):
        rows = decontamination.find_leaks(df, bench, broadcast_rows=limit).collect()
        assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows} == expected
        assert len(rows) == len(expected)
        assert all(r["hamming"] <= decontamination.RADIUS for r in rows)
    assert len(expected) > 60
    leaking = {d for d, _ in expected}
    kept = decontamination.drop_leaks(df, bench)
    assert kept.columns == df.columns
    held = [(r["doc_id"], r["text"]) for r in kept.collect()]
    wanted = [(d, t) for d, t in docs if d not in leaking or (d == 200 and t.startswith("other"))]
    assert sorted(held, key=str) == sorted(wanted, key=str)


def test_radius_loses_no_window_at_the_bound():
    """Windows of 9k shingles of which 8k are the item's have a similarity of exactly 0.8."""
    draw = np.random.default_rng(6)
    for k in (1, 2, 3, 5, 10):
        shared = draw.binomial(8 * k, 0.5, (50_000, 64))
        bits = [2 * (shared + draw.binomial(k, 0.5, shared.shape)) > 9 * k for _ in range(2)]
        apart = (bits[0] != bits[1]).sum(axis=1)
        assert (apart > decontamination.RADIUS).sum() <= 2
        assert 8.5 < apart.mean() < 10


def test_windows_ask_for_their_own_items_alone(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(400)]
    docs = [(i, " ".join([*(word() for _ in range(20)), *items[i % 40][1].split(), *(word() for _ in range(20))])) for i in range(80)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wordings = decontamination._items(bench)
    windows = decontamination._windows(spark.createDataFrame(docs, "doc_id bigint, text string"), wordings, decontamination.BROADCAST_ROWS)
    rows = windows.collect()
    assert len(rows) == 80 and all(len(r["items"]) == 1 for r in rows)


def test_odd_items_and_a_hot_passage(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(i, f"word{i} other{i} {passage} more{i}") for i in range(300)] + [(1000 + i, f"clean text number {i} without any of it") for i in range(300)]
    items = [(None, passage), (7, passage + " lambda"), (7, "quite some other words in this one"), (8, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rows = decontamination.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["start"]) for r in rows if r["item_id"] is None) == [(i, 2) for i in range(300)]
    assert {r["similarity"] for r in rows if r["item_id"] is None} == {1.0}
    assert {r["item_id"] for r in rows} <= {None, 7}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert decontamination.find_leaks(docs.limit(0), bench).collect() == []
    assert decontamination.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontamination.drop_leaks(docs, bench.limit(0)).count() == 1
    assert decontamination.drop_leaks(docs, bench).count() == 0
