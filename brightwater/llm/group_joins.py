"""Joining rows to what is known of their group, where a few groups may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.common import write_shared

#: A group with more than one of so many rows is hot. So there are fewer hot groups than this.
HOT_SHARE = 1000


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    others = [c for c in groups.columns if c not in keys]
    right = groups.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *others)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(right, same, how).select(*rows.columns, *others)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """`rows` with the other columns of `groups`, which has one row per key and its number of rows in `size`.

    Nulls in keys are equal. Hot groups are broadcast, fewer than `HOT_SHARE`
    rows whatever the data. Only rows of other groups are shuffled, so that no
    task gets more than a thousandth of all rows for one key. `how` is inner or
    left. Both tables are read several times, so they should be written ones;
    `total`, the number of rows, saves counting them where it is known.
    Columns of `groups` need a bounded width and names that `rows` does not have.
    """
    is_hot = F.col(size) * HOT_SHARE > F.lit(rows.count() if total is None else total)
    hot = write_shared(groups.where(is_hot), "hot-groups")
    if hot.isEmpty():
        return _joined(rows, groups, keys, how)
    small = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = _joined(rows, small, keys, "left")
    cold = marked.where("_hot IS NULL").select(*rows.columns)
    cold = _joined(cold, groups.where(~is_hot), keys, how)
    return marked.where("_hot").drop("_hot").unionByName(cold)
