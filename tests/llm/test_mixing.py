from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brightwater.llm import mixing
from brightwater.llm.queries import QUERIES


def targets(rows, most=2):
    """Water-filling by rounds, source by source."""
    size = defaultdict(int)
    for source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        open_weight = sum(w for s, w in weight.items() if s not in full)
        level = (total - sum(most * size[s] for s in full)) / open_weight if open_weight else 0
        new = {s for s in order if s not in full and weight[s] * level >= most * size[s]}
        if not new:
            return {s: (size[s], float(most * size[s]) if s in full else weight[s] * level) for s in order}
        full |= new


def check(docs, got):
    """got: rows joined with the source by position of the id."""
    expected = targets([(s, len((t or "").encode().split())) for _, s, t in docs])
    taken, largest = defaultdict(int), defaultdict(int)
    source_of = {d: s for d, s, _ in docs}
    for r in got:
        source = source_of[r["doc_id"]]
        assert (r["source_size"], r["target"]) == (expected[source][0], pytest.approx(expected[source][1]))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    assert len(got) == len(docs)
    return {s: (taken[s], t, largest[s]) for s, (_, t) in expected.items()}


def test_targets_are_met_and_reruns_agree(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    got = QUERIES["op1_source_mixing"](spark, data).collect()
    for taken, target, _ in check(rows, got).values():
        assert taken == pytest.approx(target, rel=0.01)
    again = mixing.mix(docs.repartition(7), broadcast_rows=0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_rates_are_tilted_by_size_and_meet_the_target(spark):
    """The rates solve the dual: one exponential in size for each source."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    for rows in by_source.values():
        assert sum(r["rate"] * r["size"] for r in rows) == pytest.approx(rows[0]["target"], rel=1e-5)
        tilts = [math.log(r["rate"]) / r["size"] for r in rows if r["size"] and r["rate"] < 2]
        assert not tilts or max(tilts) - min(tilts) < 1e-9


def test_odd_rows(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice(["a", "B", "é", "", "\U0001f600", "￿", None]), "w " * draw.randint(0, 40)) for i in range(300)]
    rows += [(400, None, None), (401, "empty", ""), (402, "empty", " \t"), (403, "long", "x " * 30_000), (404, "B", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").select("*", F.lit(1).alias("rank"), F.lit(2).alias("size"))
    for taken, target, largest in check(rows, mixing.mix(docs).collect()).values():
        assert abs(taken - target) <= max(1, largest)
    nulls = spark.createDataFrame([(None, "a", "x y")] * 4 + [(1, "b", "z")] * 2, "doc_id bigint, source string, text string")
    got = mixing.mix(nulls).collect()
    assert len(got) == 6 and {r["source_size"] for r in got} == {8, 2}


def test_rows_that_share_id_and_size_are_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_REPEATS", 7)
    rows = [(7, "a", "w " * 10)] * 400 + [(None, "b", "x " * 10)] * 400 + [(7, "c", "y " * 10)] * 400
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.mix(docs).collect()
    assert len(got) == 1200
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] in (0, 10, 20)
        taken[r["target"]] += r["taken"]
    assert sorted(taken) == [pytest.approx(10_000 / 3), pytest.approx(20_000 / 3), 8000.0]
    for target, n in taken.items():
        assert abs(n - target) < 10
    again = mixing.mix(docs.repartition(5), broadcast_rows=0).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_tilts_are_found_by_halving_too_and_a_source_without_one_is_reported(spark, monkeypatch):
    sizes = spark.createDataFrame([(0, i % 9 + 1, 10) for i in range(9)] + [(0, 20_000, 1), (1, 3, 50), (1, 90, 1)], "rank bigint, size bigint, n bigint")
    totals = [(0, 9000.0, 20_450, 91), (1, 100.0, 240, 51)]
    sources = spark.createDataFrame(totals, "rank bigint, target double, source_size bigint, n_docs bigint")
    monkeypatch.setattr(mixing, "_HALVING", 0)
    solved = {r["rank"]: r for r in mixing._tilts(sizes, sources, 2).collect()}
    words = defaultdict(float)
    for r in sizes.collect():
        tilt = solved[r["rank"]]
        words[r["rank"]] += r["n"] * r["size"] * min(2, math.exp(min(50, tilt["tilt"] * r["size"] / tilt["mean"])))
    assert [words[0], words[1]] == [pytest.approx(9000, rel=2e-6), pytest.approx(100, rel=2e-6)]
    monkeypatch.setattr(mixing, "_ROUNDS", 1)
    with pytest.raises(ArithmeticError):
        mixing._tilts(sizes, sources, 2)


def test_empty_tables(spark):
    schema = "doc_id bigint, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, "")], schema)).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
