from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwater.llm import vector_codes
from brightwater.llm.queries import QUERIES


def brute(rows):
    """rows: (vec_id, vector, label)."""
    kept = [
        (i, [math.floor(1024 * c) for c in v], label)
        for i, v, label in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), 4, width)
    books = x[:256].copy()

    def assign():
        far = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(4):
        index, _ = assign()
        for p in range(4):
            for j in set(index[:, p].tolist()):
                mine = x[index[:, p] == j, p]
                books[j, p] = [s // len(mine) for s in mine.sum(axis=0).tolist()]
    index, far = assign()
    error = far.sum(axis=1)
    by_label = {}
    for (_, _, label), e in zip(kept, error.tolist()):
        by_label[label] = by_label.get(label, 0) + e
    joined = ",".join(str(c) for p in range(4) for j in range(len(books)) for c in books[j, p].tolist())
    digest = hashlib.sha256(joined.encode()).hexdigest()
    return sorted(
        ((r[0], bytes(i.tolist()).hex(), e, by_label[r[2]], digest) for r, i, e in zip(kept, index, error.tolist())), key=str
    )


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows, component="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{component}>, label int")


def test_equals_brute_force_on_whole_table(spark):
    data = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op13_vector_codes"](spark, data)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert result(got) == brute(rows)


@pytest.mark.parametrize("seed, spread", [(1, 0.002), (2, 1.0), (3, 300.0)])
def test_ties_and_clusters(spark, seed, spread):
    """Small grids with many ties, unused entries, and wide values."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(8)] for _ in range(30)]
    rows = [(k // 2, [c + draw.gauss(0, spread / 20) for c in draw.choice(centres)], draw.choice([None, 1, 2])) for k in range(700)]
    docs = frame(spark, rows, "double").repartition(3)
    assert result(vector_codes.compress(docs)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (5, [0.5, -0.5, 0.25, 1.0], None), (5, [0.5, -0.5, 0.25, 1.0], None), (None, [0.1, 0.2, 0.3, 0.4], 1), (1, None, 1),
        (2, [0.1, None, 0.2, 0.3], 1), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [float("inf"), 0.0, 0.0, 0.0], 1),
        (0, [-0.0001, 0.0, 0.0, -0.9999], 1), (7, [0.1, 0.2, 0.3, 0.45], 2),
    ]
    docs = frame(spark, rows).select("*", F.lit(1).alias("x"), F.lit("y").alias("code"), F.lit(2).alias("label_rows"))
    single = [(i, v and [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    assert result(vector_codes.compress(docs)) == brute(single)
    assert result(vector_codes.compress(docs.limit(0))) == []
    assert result(vector_codes.compress(docs.where("vec_id = 1"))) == []
    uneven = rows + [(9, [0.1] * 8, 1), (10, [0.1] * 5, 1), (11, [], 1)]
    assert result(vector_codes.compress(frame(spark, uneven))) == brute(single)
    assert len(result(vector_codes.compress(frame(spark, [(1, [], 1), (2, [], None)])))) == 2
    huge = frame(spark, [(1, [1e30, -1e30, 0.0, 0.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1)], "double")
    assert [r["error"] for r in vector_codes.compress(huge).collect()] == [0, 0]


def test_candidates_hold_the_nearest_and_leave_most_out():
    draw = np.random.default_rng(4)
    centres = draw.integers(-900, 900, (256, 16))
    book = vector_codes.Codebook(centres)
    x = centres[draw.integers(0, 256, 3000)] + draw.integers(-40, 40, (3000, 16))
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    index, error = book.assign(x)
    assert (index == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    masks = book.within(x, np.full(len(x), 200))
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little").astype(bool)
    assert (bits == (np.abs(x[:, None] - centres[None]).max(axis=2) <= 200)).all()
    assert bits.sum() < len(x) * 3


def test_round_trip(spark):
    rows = vector_codes.whole_numbers(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    books = vector_codes.train(rows)
    coded = {r["vec_id"]: r for r in vector_codes.encode(rows, books).collect()}
    x = {r["vec_id"]: np.array(r["x"]) for r in rows.collect()}
    for vec_id, row in coded.items():
        assert ((vector_codes.decode([row["code"]], books)[0] * 1024 - x[vec_id]) ** 2).sum() == row["error"]
