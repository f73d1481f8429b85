from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402

TABLES = ["region", "nation", "supplier", "lineitem"]


def oracle(name: str, data_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS FROM '{data_dir}/{table}.parquet'")
    return con.execute(contract.oracle_sql()[name])


def test_every_core_query_has_an_oracle():
    assert contract.core_queries().keys() <= contract.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", contract.core_queries())
def test_query_equals_oracle(spark, name, sf):
    data_dir = f"/root/testdata/sf{sf}"
    df = contract.queries()[name](spark, data_dir)
    expected = oracle(name, data_dir)
    assert df.columns == [column[0] for column in expected.description]
    rows = [tuple(row) for row in df.collect()]
    assert rows
    assert sorted(rows) == sorted(expected.fetchall())


def plain_sums(data_dir: str):
    """Double sums of the values as they are, which share no rounding with the oracle."""
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS FROM '{data_dir}/{table}.parquet'")
    return con.execute(
        "SELECT r_name, sum(l_extendedprice * (1 - l_discount)), count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
        "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
    ).fetchall()


@pytest.mark.parametrize("name", contract.core_queries())
def test_query_equals_sums_without_rounding(spark, name):
    data_dir = "/root/testdata/sf0.1"
    got = {r["r_name"]: (r["revenue"], r["n"]) for r in contract.core_queries()[name](spark, data_dir).collect()}
    plain = plain_sums(data_dir)
    assert got.keys() == {r[0] for r in plain}
    for region, revenue, n in plain:
        assert got[region][1] == n
        assert abs(float(got[region][0]) - revenue) < 0.01


@pytest.mark.parametrize("name", contract.core_queries())
def test_a_discount_off_the_grid_is_not_rounded_away(spark, tmp_path, name):
    for table in TABLES:
        source = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        if table == "lineitem":
            source = source.withColumn("l_discount", F.lit(0.125))
        source.write.parquet(str(tmp_path / f"{table}.parquet"))
    with pytest.raises(Exception, match="not whole cents and percents"):
        contract.core_queries()[name](spark, str(tmp_path)).collect()


def test_types_equal_oracle(spark):
    types = ["string", "decimal(38,4)", "bigint"]
    for name, query in contract.core_queries().items():
        assert [t for _, t in query(spark, "/root/testdata/sf0.001").dtypes] == types
        described = [str(c[1]) for c in oracle(name, "/root/testdata/sf0.001").description]
        assert described == ["VARCHAR", "DECIMAL(38,4)", "BIGINT"]


def test_table_may_be_a_folder_of_files(spark, tmp_path):
    for table in TABLES:
        source = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        source.repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    whole = contract.entry(spark).collect()
    for query in contract.core_queries().values():
        assert sorted(query(spark, str(tmp_path)).collect()) == sorted(whole)


def test_declared_schemas_match_the_files(spark):
    from brightwater.sources.tables import SCHEMAS, read_table

    for name in SCHEMAS:
        path = f"/root/testdata/sf0.001/{name}.parquet"
        declared = read_table(spark, "/root/testdata/sf0.001", name).dtypes
        assert declared == spark.read.parquet(path).dtypes


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_RUNS="1", BENCH_QUERIES=",".join(contract.core_queries()))
    done = subprocess.run(
        [sys.executable, str(ROOT / "bench.py")], env=env, capture_output=True, text=True, timeout=300
    )
    lines = done.stdout.strip().splitlines()
    assert len(lines) == 1, done.stderr
    report = json.loads(lines[0])
    assert report["unit"] == "sec" and report["sf"] == 0.001
    assert report["queries"].keys() == contract.core_queries().keys()
    assert report["value"] == pytest.approx(sum(report["queries"].values()), abs=0.01)
