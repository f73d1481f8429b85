from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brightwater.llm import group_joins, refinement
from brightwater.llm.queries import QUERIES


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in ids:
            kept = d == keep and left == 1
            left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def marked(docs):
    return result(refinement.mark_copies(docs, carry={"h": F.sha2(F.coalesce("text", F.lit("")), 256)}))


def test_equals_brute_force_on_whole_table(spark):
    data = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_exact_dedup"](spark, data)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert result(got) == brute(rows)
    assert sum(not r["kept"] for r in got.collect()) > 500


@pytest.mark.parametrize("bits", [32, 1 << 22])
def test_near_misses_and_ties(spark, monkeypatch, bits):
    """Texts equal in length and beginning, on bitmaps where nearly all keys collide and on wide ones."""
    monkeypatch.setattr(refinement, "LENGTH_BITS", bits)
    monkeypatch.setattr(refinement, "PREFIX_BITS", bits)
    draw = random.Random(3)
    head = "same beginning " * 40
    rows = [(None, None), (1, ""), (None, ""), (2, " "), (3, "É"), (4, "é"), (4, "É"), (5, "é"), (7, "x"), (7, "x"), (None, "n"), (None, "n")]
    rows += [(10 + k, head + draw.choice("abcd")) for k in range(40)] + [(90, head), (91, head + head)]
    rows += [(200 + k, "hot") for k in range(300)] + [(600, "long " * 100_000), (601, "long " * 100_000), (602, "long " * 99_999 + "lang ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert marked(docs) == brute(rows)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", 5, "u"), (2, "a", 6, "v"), (2, "a", 6, "v"), (3, "b", 7, "w")], "doc_id bigint, text string, full int, place string")
    docs = docs.select("*", F.lit(1).alias("kept"), F.lit(2).alias("prefix"), F.lit(3).alias("length"), F.lit(4).alias("bitmap"))
    assert len(marked(docs)) == 4
    kept = refinement.drop_copies(docs)
    assert kept.columns == docs.columns and result(kept) == [(2, "a", 6, "v", 1, 2, 3, 4), (3, "b", 7, "w", 1, 2, 3, 4)]
    assert marked(docs.limit(0)) == [] and refinement.drop_copies(docs.limit(0)).columns == docs.columns


def test_no_python_and_no_text_in_a_shuffle(spark):
    plan = QUERIES["op11_exact_dedup"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "whole" not in plan


def test_hot_groups_join_without_a_shuffle_of_their_rows(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7000).alias("k"), "id").repartition(4)
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = group_joins.join_groups(rows, groups, ["k"], "n").collect()
    assert len(got) == 30_000
    top = {r["k"]: r["top"] for r in groups.collect()}
    assert all(r["top"] == top[r["k"]] for r in got)
    left = group_joins.join_groups(rows, groups.where("k > 5 OR k IS NULL"), ["k"], "n", "left").collect()
    assert len(left) == 30_000 and {r["k"] for r in left if r["top"] is None} == {0, 1, 2, 3, 4, 5}
