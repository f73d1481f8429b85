"""The physical plans that the strategies are chosen for."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from brightwater.plans.revenue import revenue_by_supplier_region

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(params=[None, 0], ids=["broadcast", "shuffle"])
def either(request, spark):
    if request.param is None:
        return plan(revenue_by_supplier_region(spark, SF))
    return plan(revenue_by_supplier_region(spark, SF, limit_bytes=0))


def test_scans_read_only_the_columns_used(either):
    assert sorted(re.findall(r"ReadSchema: struct<(.*?)>", either)) == sorted(
        [
            "l_suppkey:bigint,l_extendedprice:double,l_discount:double",
            "s_suppkey:bigint,s_nationkey:int",
            "n_nationkey:int,n_regionkey:int",
            "r_regionkey:int,r_name:string",
        ]
    )


def test_filters_reach_the_scan(either):
    assert "PushedFilters: [IsNotNull(l_suppkey)]" in either
    assert "PushedFilters: [IsNotNull(s_suppkey), IsNotNull(s_nationkey)]" in either


def test_no_product_python_or_per_line_string(either):
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert operator not in either
    # names meet only the per-nation sums, above every step that handles lines
    assert "r_name" not in either[either.index("keys=[s_nationkey") : either.index("FileScan")]


def test_lines_are_summed_in_primitives(spark):
    """Decimals appear once, in the projection above the last sum."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        revenue_by_supplier_region(spark, SF).explain("extended")
    optimized = out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical")[0]
    with_decimals = [line for line in optimized.splitlines() if "decimal(" in line]
    assert len(with_decimals) == 1
    assert with_decimals[0].startswith("Aggregate [r_name")


def test_small_lookup_never_shuffles_lines(spark):
    text = plan(revenue_by_supplier_region(spark, SF))
    assert text.count("BroadcastHashJoin") == 3
    assert re.findall(r"\bExchange hashpartitioning\((\w+)#", text) == ["r_name", "s_nationkey"]


def test_large_lookup_sums_before_its_one_shuffle_of_lines(spark):
    text = plan(revenue_by_supplier_region(spark, SF, limit_bytes=0))
    assert text.count("SortMergeJoin") == 1
    exchanges = re.findall(r"\bExchange hashpartitioning\((\w+)#", text)
    assert sorted(exchanges) == ["r_name", "s_nationkey", "suppkey", "suppkey"]
    lines = text[: text.index("l_suppkey#")]
    assert re.search(r"Exchange hashpartitioning\(suppkey.*\n.*HashAggregate\(keys=\[suppkey.*partial_sum", lines)
