"""Discounted revenue and line count by region of the supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.functions.money import amount, discounted_units, high_part, low_part
from brightwater.operators.lookup_sum import BROADCAST_LIMIT_BYTES, sum_through_lookup
from brightwater.sources.tables import read_table

_SUMS = ["high", "low", "n"]


def revenue_by_supplier_region(
    spark: SparkSession, data_dir: str, limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Columns `r_name`, `revenue` decimal(38,4) and `n` bigint.

    Lines are first summed by the integer nation key of their supplier. The
    names are joined to that small result, so no string is handled per line.
    """
    units = discounted_units(F.col("l_extendedprice"), F.col("l_discount"))
    lines = read_table(spark, data_dir, "lineitem").select(
        F.col("l_suppkey").alias("suppkey"),
        high_part(units).alias("high"),
        low_part(units).alias("low"),
        F.lit(1).alias("n"),
    )
    suppliers = read_table(spark, data_dir, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), "s_nationkey"
    )
    by_nation = sum_through_lookup(
        lines, suppliers, "suppkey", "s_nationkey", _SUMS, limit_bytes
    )
    nation = read_table(spark, data_dir, "nation")
    region = read_table(spark, data_dir, "region")
    return (
        by_nation.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(*[F.sum(name).alias(name) for name in _SUMS])
        .select("r_name", amount(F.col("high"), F.col("low")).alias("revenue"), "n")
    )


REVENUE_BY_SUPPLIER_REGION_SQL = """
SELECT r_name,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))
                * (1 - CAST(l_discount AS DECIMAL(3, 2)))) AS DECIMAL(38, 4)) AS revenue,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
"""
