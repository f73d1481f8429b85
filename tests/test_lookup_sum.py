from __future__ import annotations

from collections import defaultdict
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightwater.operators.lookup_sum import (
    BROADCAST_LIMIT_BYTES,
    fits_broadcast,
    sum_through_lookup,
)

# The bound for a lookup of two columns.
TABLE_BYTES = 80 * 1024 * 1024
ROW_BYTES = 160

LIMITS = {"broadcast": BROADCAST_LIMIT_BYTES, "shuffle": 0}


def brute_force(facts, lookup):
    sums = defaultdict(list)
    for fact_key, measure in facts:
        for lookup_key, group in lookup:
            if fact_key is not None and fact_key == lookup_key:
                sums[group].append(measure)
    return {
        group: (sum(v for v in values if v is not None) if any(v is not None for v in values) else None)
        for group, values in sums.items()
    }


def run(spark, facts, lookup, limit):
    facts = spark.createDataFrame(facts, "k bigint, m bigint").repartition(3)
    lookup = spark.createDataFrame(lookup, "k bigint, g int").repartition(3)
    rows = sum_through_lookup(facts, lookup, "k", "g", ["m"], limit).collect()
    result = {row["g"]: row["m"] for row in rows}
    assert len(result) == len(rows)
    return result


# Few distinct keys: missing, repeated and null keys all occur on both sides.
keys = st.one_of(st.none(), st.integers(0, 5))
small = st.one_of(st.none(), st.integers(-1000, 1000))
groups = st.one_of(st.none(), st.integers(0, 3))


@pytest.mark.parametrize("strategy", LIMITS)
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    facts=st.lists(st.tuples(keys, small), max_size=30),
    lookup=st.lists(st.tuples(keys, groups), max_size=12),
)
def test_equals_brute_force(spark, strategy, facts, lookup):
    assert run(spark, facts, lookup, LIMITS[strategy]) == brute_force(facts, lookup)


@pytest.mark.parametrize("strategy", LIMITS)
def test_hot_key(spark, strategy):
    facts = [(7, i) for i in range(500)] + [(i, 1) for i in range(1000)]
    lookup = [(i, i % 4) for i in range(900)]
    assert run(spark, facts, lookup, LIMITS[strategy]) == brute_force(facts, lookup)


def test_hot_key_is_one_row_per_task_in_the_shuffle(spark, conf):
    """A key holding a third of all rows must not travel row by row."""
    conf("spark.sql.adaptive.enabled", "false")
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("bigint")
    facts = spark.range(0, 90_000, 1, 4).select(key.alias("k"), F.lit(1).cast("bigint").alias("m"))
    lookup = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 4).cast("int").alias("g"))
    df = sum_through_lookup(facts, lookup, "k", "g", ["m"], 0)
    assert {r["g"]: r["m"] for r in df.collect()} == {
        r["g"]: r["m"] for r in facts.join(lookup, "k").groupBy("g").agg(F.sum("m").alias("m")).collect()
    }
    plan = df._jdf.queryExecution().executedPlan()
    written = shuffle_records(plan)
    assert len(written) == 3  # facts by key, lookup by key, sums by group
    # 4 tasks with at most 50 keys each, 50 lookup rows, 8 reducers with 4 groups
    assert sorted(written)[-1] <= 4 * 50


def shuffle_records(node):
    found = []
    if node.nodeName() == "Exchange":
        found.append(node.metrics().apply("shuffleRecordsWritten").value())
    children = node.children()
    for i in range(children.size()):
        found += shuffle_records(children.apply(i))
    return found


def test_fits_broadcast(spark):
    numbers = spark.range(100).select(F.col("id").alias("k"), F.col("id").cast("int").alias("g"))
    assert fits_broadcast(numbers)
    assert fits_broadcast(numbers, TABLE_BYTES + 100 * ROW_BYTES)
    assert not fits_broadcast(numbers, TABLE_BYTES + 100 * ROW_BYTES - 1)
    assert not fits_broadcast(numbers, 0)


def test_strings_are_bounded_by_the_longest(spark):
    rows = [(i, "x" * (i % 40), Decimal(i)) for i in range(100)]
    lookup = spark.createDataFrame(rows, "k bigint, g string, d decimal(30,2)")
    row = 128 + 3 * 16 + 16 + 39 + 8
    assert fits_broadcast(lookup, TABLE_BYTES + 100 * row)
    assert not fits_broadcast(lookup, TABLE_BYTES + 100 * row - 1)
    assert not fits_broadcast(spark.createDataFrame([(1, ["a"])], "k bigint, g array<string>"))
    assert fits_broadcast(spark.createDataFrame([], "k bigint, g string"))


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_string_lookup_leaves_the_facts_where_they_are(spark):
    facts = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("m"))
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "k bigint, g string")
    small = sum_through_lookup(facts, lookup, "k", "g", ["m"])
    assert "BroadcastHashJoin" in explained(small) and "SortMergeJoin" not in explained(small)
    large = sum_through_lookup(facts, lookup, "k", "g", ["m"], TABLE_BYTES + 3 * (160 + 8))
    assert "SortMergeJoin" in explained(large) and "BroadcastHashJoin" not in explained(large)
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)


def jobs_of(spark, build) -> int:
    group = f"jobs-{build.__name__}-{id(build)}"
    spark.sparkContext.setJobGroup(group, group)
    build()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_derived_lookup_is_not_evaluated_to_be_counted(spark):
    facts = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("m"))
    derived = spark.range(100).groupBy((F.col("id") % 3).alias("k")).agg(F.max("id").alias("g"))
    found = {}

    def unknown():
        found["merge"] = sum_through_lookup(facts, derived, "k", "g", ["m"])

    def bounded():
        found["broadcast"] = sum_through_lookup(facts, derived, "k", "g", ["m"], max_rows=3)

    assert jobs_of(spark, unknown) == 0 and jobs_of(spark, bounded) == 0
    assert "SortMergeJoin" in explained(found["merge"]) and "BroadcastHashJoin" in explained(found["broadcast"])
    assert sorted(found["merge"].collect()) == sorted(found["broadcast"].collect())


TYPES = {"int": (9, 0), "bigint": (15, 0), "decimal(12,2)": (9, 2), "decimal(30,8)": (20, 8)}


@pytest.mark.parametrize("kind", TYPES)
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_type_and_value_do_not_depend_on_the_strategy(spark, kind, data):
    digits, scale = TYPES[kind]
    measure = st.one_of(st.none(), st.integers(-(10**digits), 10**digits))
    facts = data.draw(st.lists(st.tuples(keys, measure), max_size=30))
    lookup = data.draw(st.lists(st.tuples(keys, groups), max_size=12))
    cast = (lambda m: m) if not kind.startswith("decimal") else (lambda m: m if m is None else Decimal(m).scaleb(-scale))
    facts = spark.createDataFrame([(k, cast(m)) for k, m in facts], f"k bigint, m {kind}").repartition(3)
    lookup = spark.createDataFrame(lookup, "k bigint, g int")
    got = [sum_through_lookup(facts, lookup, "k", "g", ["m"], limit) for limit in LIMITS.values()]
    assert got[0].dtypes == got[1].dtypes == [("g", "int"), *facts.agg(F.sum("m").alias("m")).dtypes]
    assert sorted(got[0].collect(), key=str) == sorted(got[1].collect(), key=str)


def test_floats_and_clashing_names_are_rejected(spark):
    lookup = spark.createDataFrame([(1, 1)], "k bigint, g int")
    for kind in ("float", "double"):
        with pytest.raises(TypeError, match=f"m is {kind}"):
            sum_through_lookup(spark.createDataFrame([(1, 1.0)], f"k bigint, m {kind}"), lookup, "k", "g", ["m"])
    facts = spark.createDataFrame([(1, 2, 3)], "k bigint, g bigint, m bigint")
    with pytest.raises(ValueError, match="names of their own"):
        sum_through_lookup(facts, lookup, "k", "g", ["g"])
    for limit in LIMITS.values():
        assert sum_through_lookup(facts, lookup, "k", "g", ["k", "m"], limit).collect() == [(1, 1, 3)]


def test_empty_lookup_is_not_broadcast_when_broadcasting_is_off(spark):
    assert not fits_broadcast(spark.createDataFrame([], "k bigint, g int"), 0)


@pytest.mark.parametrize("kind", ["dense", "sparse", "double"])
def test_bound_covers_the_real_hash_table(spark, kind):
    """Measured just past a doubling, where the table has the most room to spare."""
    rows = 2**17 + 1
    key = {
        "dense": F.col("id"),
        "sparse": F.xxhash64("id"),
        "double": F.xxhash64("id").cast("double"),
    }[kind]
    lookup = spark.range(rows).select(key.alias("k"), (F.col("id") % 25).cast("int").alias("g"))
    facts = spark.range(rows).select(key.alias("k"), F.lit(1).alias("m"))
    df = sum_through_lookup(facts, lookup, "k", "g", ["m"])
    assert sum(r["m"] for r in df.collect()) == rows
    used = broadcast_bytes(df._jdf.queryExecution().executedPlan())
    assert 0 < used <= TABLE_BYTES + rows * ROW_BYTES
    if kind != "double":
        assert used <= rows * ROW_BYTES


def broadcast_bytes(node):
    name = node.nodeName()
    if name == "BroadcastExchange":
        return node.metrics().apply("dataSize").value()
    if name == "AdaptiveSparkPlan":
        return broadcast_bytes(node.executedPlan())
    if name.endswith("QueryStage"):
        return broadcast_bytes(node.plan())
    children = node.children()
    return sum(broadcast_bytes(children.apply(i)) for i in range(children.size()))
