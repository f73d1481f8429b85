"""Sums of a fact table by an attribute that a lookup table holds per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest hash table that is sent whole to every executor.
BROADCAST_LIMIT_BYTES = 512 * 1024 * 1024

# Fixed values, together an upper bound on the memory of a hash table: its first
# memory page, each row's slots, pointers and header with room for growth by
# doubling, each field, and what a wide decimal or a string takes beside it.
_TABLE_BYTES = 80 * 1024 * 1024
_ROW_BYTES = 128
_FIELD_BYTES = 16
_WORD_BYTES = 8
_WIDE_DECIMAL_BYTES = 16

_FIXED_WIDTH = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType,
)
_COUNTED_WIDTH = (T.StringType, T.BinaryType)
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def _reads_a_source(df: DataFrame) -> bool:
    """Whether `df` only selects from one source, so that counting it repeats no work."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.children().isEmpty()


def fits_broadcast(
    lookup: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES, max_rows: int | None = None
) -> bool:
    """Whether a hash table of `lookup` is sure to stay within `limit_bytes`.

    Rows are counted by a Spark job where `lookup` reads one source; for plain
    Parquet that takes the footers alone. A lookup that is derived by a join or
    an aggregation would be evaluated for the count and once more for its use,
    so it is not counted: it fits only if the caller passes `max_rows`, a bound
    that it is known to keep. Strings are bounded by their longest value, which
    reads those columns, once the number of rows alone would fit. Nested
    columns give no bound.
    """
    fields = lookup.schema.fields
    if not all(isinstance(field.dataType, _FIXED_WIDTH + _COUNTED_WIDTH) for field in fields):
        return False
    wide = sum(isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 18 for f in fields)
    row_bytes = _ROW_BYTES + _FIELD_BYTES * len(fields) + _WIDE_DECIMAL_BYTES * wide
    most_rows = (limit_bytes - _TABLE_BYTES) // row_bytes
    if most_rows <= 0:
        return False
    known = max_rows is None and _reads_a_source(lookup)
    if max_rows is None and not known:
        return False
    rows = lookup.count() if known else max_rows
    if rows > most_rows:
        return False
    counted = [f.name for f in fields if isinstance(f.dataType, _COUNTED_WIDTH)]
    if not counted:
        return True
    if not _reads_a_source(lookup):
        return False
    longest = lookup.agg(*[F.max(F.octet_length(F.col(f"`{name}`"))) for name in counted]).first()
    row_bytes += sum((n or 0) + _WORD_BYTES for n in longest)
    return _TABLE_BYTES + rows * row_bytes <= limit_bytes


def sum_through_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    by: str,
    measures: list[str],
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    max_rows: int | None = None,
) -> DataFrame:
    """Sum `measures` of `facts` by the column `by` that `lookup` holds for `key`.

    Measures are integers or decimals; a sum has the type that Spark gives one
    `sum` of the measure, whichever strategy the size of the lookup selects.
    Sums of floats depend on their order, so floats are rejected.

    A lookup of proven small size is broadcast: the facts are never shuffled.
    A larger one meets facts already summed per key. A key that holds a large
    share of the facts is then reduced to one row per map task before the
    shuffle, and the join reuses the partitioning of that sum. The merge hint
    keeps Spark from broadcasting this lookup on an estimate. The per-key sums
    are the side it buffers, so it holds one row at a time even where a lookup
    repeats a key. For `max_rows` see `fits_broadcast`.
    """
    if by in (key, *measures) or len(set(measures)) < len(measures):
        raise ValueError(f"the columns need names of their own: key {key}, by {by}, measures {measures}")
    for measure in measures:
        kind = facts.schema[measure].dataType
        if not isinstance(kind, _EXACT):
            raise TypeError(f"{measure} is {kind.simpleString()}; sums are exact for integers and decimals only")
    prefix = "sum_of_"
    while any(name.startswith(prefix) for name in (key, by)):
        prefix = f"_{prefix}"
    types = {f.name: f.dataType for f in facts.agg(*[F.sum(m).alias(m) for m in measures]).schema.fields}
    sums = [F.sum(prefix + m).alias(prefix + m) for m in measures]
    facts = facts.select(key, *[F.col(m).alias(prefix + m) for m in measures])
    lookup = lookup.select(key, by)
    if fits_broadcast(lookup, limit_bytes, max_rows):
        joined = facts.join(F.broadcast(lookup), key)
    else:
        joined = lookup.hint("merge").join(facts.groupBy(key).agg(*sums), key)
    return joined.groupBy(by).agg(*sums).select(by, *[F.col(prefix + m).cast(types[m]).alias(m) for m in measures])
