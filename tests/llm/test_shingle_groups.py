from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwater.llm import shingle_groups
from test_simhash_pivots import LOWER


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows):
    """Groups of row numbers whose sets are similar by 0.8 or more."""
    sets = {}
    for k, (_, text) in enumerate(rows):
        sets.setdefault(shingles(text), []).append(k)
    nodes = list(sets)
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(nodes):
        shared = {}
        for g in s:
            for j in where.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            where[g].append(i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(nodes[j]) - n):
                root[find(i)] = find(j)
    out = {}
    for i, s in enumerate(nodes):
        out.setdefault(find(i), []).extend(sets[s])
    return {frozenset(g) for g in out.values()}


def groups_of(spark, rows):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    out = {}
    for r in shingle_groups.with_groups(docs).collect():
        out.setdefault(r["root"], []).append(r["doc_id"])
    return {frozenset(g) for g in out.values()}


def test_near_copies_at_every_similarity(spark):
    draw = random.Random(9)
    rows = [(0, None), (0, ""), (0, "one two"), (0, "ONE two"), (0, "one"), (0, "a b c d e f g h"), (0, "a b c d e f g h i")]
    for _ in range(60):
        words = [f"w{draw.randrange(900)}" for _ in range(draw.choice([6, 9, 14, 30, 60, 150, 400]))]
        for _ in range(5):
            copy = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(900)}"
            rows.append((0, " ".join(copy)))
    expected = brute_groups(rows)
    assert groups_of(spark, rows) == expected
    assert any(len(g) == 1 for g in expected) and any(len(g) > 2 for g in expected)


def test_stage_drops_near_copies_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = {min(rows[k][0] for k in g) for g in brute_groups(rows)}
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()]
    print(len(rows), len(got))
    assert len(got) == len(set(got)) and set(got) == expected


def test_odd_rows_keep_one_of_each_group(spark):
    long = " ".join(f"word{i % 900} and{i}" for i in range(20_000))
    text, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [
        (None, None), (None, ""), (3, " \t"), (None, text), (7, text.upper()), (6, text + " one"), (6, text + " one"), (6, text + " two"),
        (None, other), (None, other), (None, other + " z"), (9, long), (8, long + " more"), (10, "one two three four"), (4, "a b c d e"), (4, "a b c d e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["id", "sign", "n", "fp", "root", "row_key", "doc", "_row", "bitmap", "stays", "key", "rows"])])
    kept = shingle_groups.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(d for d, _ in got if d is not None) == [3, 4, 6, 8, 10]
    assert [t for d, t in got if d is None] in ([other], [other + " z"])
    assert [t for d, t in got if d == 6] in ([text + " one"], [text + " two"])
    empty = shingle_groups.keep_first(docs.limit(0))
    assert empty.columns == docs.columns and empty.collect() == []


def test_many_near_copies_take_few_comparisons(spark, monkeypatch):
    """A third of all rows near one text, a passage in another third; all links are found, with hot parts dealt out."""
    monkeypatch.setattr(shingle_groups, "MEET", 16)
    monkeypatch.setattr(shingle_groups, "PARTNERS", 4)
    draw = random.Random(2)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(80)]
    rows = []
    for k in range(300):
        if k % 3 == 0:
            words = list(base)
            for _ in range(draw.choice([0, 1, 2, 2, 3])):
                words[draw.randrange(120)] = f"c{k}"
        elif k % 3 == 1:
            words = passage + [f"q{draw.randrange(10**6)}" for _ in range(draw.choice([2, 12, 60]))]
        else:
            words = [f"r{draw.randrange(10**6)}" for _ in range(100)]
        rows.append((0, " ".join(words)))
    tried = []
    similar = shingle_groups._similar
    monkeypatch.setattr(shingle_groups, "_similar", lambda pairs, *rest: tried.append(pairs.count()) or similar(pairs, *rest))
    monkeypatch.setattr(shingle_groups, "CELLS", 1000)
    assert groups_of(spark, rows) == brute_groups(rows)
    assert 0 < sum(tried) <= 2 * 300


@pytest.mark.parametrize("size", [5, 6, 9, 14, 20, 28, 40, 60, 100, 250, 700, 2000, 8000, 20000])
def test_pairs_at_the_bound_share_a_part_and_pass_the_fingerprints(size):
    """Pairs of sets at the least similarity allowed, of equal and of unequal sizes: none in the draw is missed."""
    draw = np.random.default_rng(size)
    times = max(25, min(400, 400_000 // size))
    missed = far = 0
    for _ in range(times):
        total = draw.integers(0, 1 << 63, 3 * size).astype(np.uint64)
        split = draw.random()
        # whole has at most 5 / 4 of common, dealt to either side
        common, extra = size, size // 4
        left = int(round(extra * split))
        a, b = np.unique(total[: common + left]), np.unique(np.r_[total[:common], total[common + left : common + extra]])
        assert 5 * common >= 4 * (common + extra)
        missed += not np.intersect1d(shingle_groups.signatures(a), shingle_groups.signatures(b)).size
        if min(len(a), len(b)) >= shingle_groups.FEW:
            far += int(shingle_groups.fingerprint(a) ^ shingle_groups.fingerprint(b)).bit_count() > shingle_groups.RADIUS
    assert missed == 0 and far == 0


def test_sets_that_share_their_first_hash_stay_apart(spark):
    rows = [(k, k, 1 if k < 3 else k, k // 2, 5, 0, [k]) for k in range(6)]
    signed = spark.createDataFrame(rows, "doc_id bigint, row_key bigint, id bigint, second bigint, n int, fp bigint, signs array<bigint>")
    told, nodes = shingle_groups._told_apart(signed)
    ids = {r["doc_id"]: r["id"] for r in told.collect()}
    assert ids[0] == ids[1] != ids[2] and nodes.count() == 5


def _pair(draw, common, left, right):
    """Two sets with `common` shingles in both and others in one each."""
    total = np.unique(draw.integers(0, 1 << 63, common + left + right + 9).astype(np.uint64))
    draw.shuffle(total)
    return np.sort(total[: common + left]), np.sort(np.r_[total[:common], total[common + left : common + left + right]])


@pytest.mark.parametrize("size", [16, 20, 28, 60, 250, 2000])
def test_wide_fingerprints_keep_pairs_at_the_bound_and_discard_less_similar_ones(size):
    draw = np.random.default_rng(size)
    distance = lambda sets: int(np.bitwise_count(np.bitwise_xor(*map(shingle_groups.wide_fingerprint, sets))).sum())
    times = max(20, min(200, 40_000 // size))
    for _ in range(times):
        left = int(round(size // 4 * draw.random()))
        assert distance(_pair(draw, size, left, size // 4 - left)) <= shingle_groups.WIDE_RADIUS
    # similar by a half or less
    assert sum(distance(_pair(draw, size, size // 2, size - size // 2)) <= shingle_groups.WIDE_RADIUS for _ in range(times)) <= times / 20


@pytest.mark.parametrize("two_blocks", [False, True])
def test_sets_that_meet_are_judged_by_wide_fingerprints(two_blocks):
    """Same verdicts as all distances, with reference fingerprints; small sets are near whatever theirs are."""
    draw = np.random.default_rng(7)
    pairs = [s for k in range(40) for s in _pair(draw, 100, 5 + k, 5 + k)]
    wide = np.array([shingle_groups.wide_fingerprint(s) for s in pairs])
    sizes, roots, blocks = np.array([len(s) for s in pairs]), np.arange(80) // 4, np.arange(80) % 2
    roots[:60] = np.arange(60)
    bits = np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2, dtype=int)
    meets = (roots[:, None] != roots) & (5 * sizes[:, None] >= 4 * sizes) & (5 * sizes >= 4 * sizes[:, None])
    if two_blocks:
        meets &= blocks[:, None] != blocks
    got = shingle_groups.near_another(roots, sizes, blocks, wide, two_blocks)
    expected = (meets & (bits <= shingle_groups.WIDE_RADIUS)).any(axis=1)
    assert 0 < expected.sum() < 60 and got.tolist() == expected.tolist()
    few = np.full(3, 5)
    assert shingle_groups.near_another(np.arange(3), few, np.arange(3), wide[[0, 2, 4]], two_blocks).all()


def test_only_sets_with_a_near_fingerprint_send_their_shingles(spark, monkeypatch):
    """Texts with a passage in common share parts, but none is near another, so that no set is read for the meeting."""
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    rows = [(0, " ".join(passage + [f"q{draw.randrange(10**6)}" for _ in range(110)])) for _ in range(60)]
    read, met, sets, near = [], [], shingle_groups._sets, shingle_groups._near_in_parts
    monkeypatch.setattr(shingle_groups, "_sets", lambda ids, *rest: read.append(ids.count()) or sets(ids, *rest))
    monkeypatch.setattr(shingle_groups, "_near_in_parts", lambda dealt: met.append(dealt.count()) or near(dealt))
    assert len(groups_of(spark, rows)) == 60
    assert sum(met) > 0 and sum(read) == 0


def test_few_tables_are_written(spark, monkeypatch):
    """Each table is a query that the driver keeps; with two rounds of centres there were over sixty here."""
    from brightwater.llm import bitmaps, components, group_joins

    draw = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(90):
        words = list(base) if k % 2 else [f"r{draw.randrange(10**6)}" for _ in range(100)] + base[:60]
        for _ in range(draw.choice([0, 1, 2])):
            words[draw.randrange(100)] = f"c{k}"
        rows.append((k, " ".join(words)))
    written, write = [], shingle_groups.write_shared
    for module in (shingle_groups, bitmaps, components, group_joins):
        monkeypatch.setattr(module, "write_shared", lambda df, name: written.append(name) or write(df, name))
    assert shingle_groups.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 46
    print("written", len(written))
    assert len(written) <= 45
