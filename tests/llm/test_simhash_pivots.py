from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from brightwater.llm import simhash_pivots
from brightwater.llm.queries import QUERIES

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").translate(LOWER).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint); smallest doc_id reachable of each row."""
    distinct = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            least[find(fp)] = min(doc_id, least.get(find(fp), doc_id))
    return sorted(((d, f"{fp:016x}", least.get(find(fp))) for d, fp in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_on_whole_table(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    expected = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs])
    assert result(QUERIES["op9_simhash_near_dedup"](spark, data)) == expected
    assert any(row[0] != row[2] for row in expected)


def test_odd_rows(spark):
    rows = [
        (1, None, 7), (2, "", 7), (3, " \t\n", 7), (None, "one", 7), (4, "ONE", 7), (4, "ONE", 7),
        (5, "two words", 7), (6, "É é x", 7), (None, None, 7), (7, "word " * 30_000, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int").select("*", F.lit("x").alias("key"))
    expected = brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows])
    assert result(simhash_pivots.near_duplicates(docs)) == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert result(simhash_pivots.near_duplicates(docs)) == []


@pytest.mark.parametrize("bucket", [16, 64])
def test_pairs_in_dense_buckets(spark, bucket):
    """Fingerprints around few centres, so that buckets must be dealt out again and again."""
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(3)]
    found = set(centres)
    for _ in range(250):
        x = draw.choice(centres)
        for _ in range(draw.randint(1, 4)):
            x ^= 1 << draw.choice((draw.randrange(64), draw.randrange(48, 64)))
        found.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    rows = [tuple(r) for r in simhash_pivots.near_pairs(df, bucket).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == expected


def test_coordinates_tell_the_block_and_bound_the_distance():
    draw = random.Random(6)
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))
        far = [((a ^ p).bit_count(), (b ^ p).bit_count()) for p in simhash_pivots.PIVOTS]
        assert max(abs(x - y) for x, y in far) <= 2
        same = [
            all(far[k][0] - far[0][0] == far[k][1] - far[0][1] for k in range(1 + 8 * block, 9 + 8 * block)) for block in range(4)
        ]
        assert sum(same) >= 2
