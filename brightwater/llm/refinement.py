"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Every step looks only at rows whose group of the step before has two rows or
more. What survives a step is kept as a bitmap of fixed size over hashed group
keys: some 16 MB that can be broadcast however many groups there are. Two keys
on one bit let a row through to the next step for nothing, and the last step,
SHA-256 of the whole text, decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm.bitmaps import bitmap_of, marked
from brightwater.llm.common import write_shared
from brightwater.llm.group_joins import join_groups

#: Code points that the second step hashes.
PREFIX = 256
#: Bits of the survivors' bitmaps.
LENGTH_BITS = 1 << 22
PREFIX_BITS = 1 << 27


def _repeated(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap of the keys that two or more rows have."""
    return bitmap_of(rows.groupBy(key).count().where("count > 1"), key, bits)


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Columns `doc_id`, `keep_id`, `group_size`, `kept` and those of `carry`, one row per row of `docs`.

    Texts that are identical, unchanged, are one group; a null text counts as
    empty. Of a group the row with the largest id is kept and gives `keep_id`;
    null ids are below all others, and a group of null ids alone has a null
    `keep_id`. Of rows that share text and largest id one is kept, the one that
    is read last, so each group keeps exactly one row. Very long texts are
    hashed whole. An empty table gives no rows. `carry` names further columns
    to compute from `docs`; columns of `docs` that it does not name are left
    out, so their names cannot clash. Its names may not be those above.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    length = F.octet_length(whole)
    prefix = F.xxhash64(length, F.substring(whole, 1, PREFIX))

    grouped = write_shared(docs.select(length.alias("length"), prefix.alias("prefix")), "lengths")
    lengths = _repeated(grouped, "length", LENGTH_BITS)
    grouped = marked(grouped, "length", lengths, LENGTH_BITS, "survives").where("survives")
    prefixes = _repeated(grouped, "prefix", PREFIX_BITS)

    carried = F.struct(F.lit(0), *[c.alias(n) for n, c in (carry or {}).items()])
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("place"), carried.alias("carried"),
        whole.alias("whole"), prefix.alias("prefix"),
    )
    rows = marked(rows, "prefix", prefixes, PREFIX_BITS, "survives")
    full = F.when(F.col("survives"), F.sha2("whole", 256))
    rows = write_shared(rows.select("doc_id", "place", "carried", full.alias("full")), "hashed")

    compared = rows.where("full IS NOT NULL")
    groups = compared.groupBy("full").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "place")).alias("last"))
    groups = write_shared(groups.where("group_size > 1"), "copies")
    compared = join_groups(compared, groups, ["full"], "group_size", "left")
    single = rows.where("full IS NULL").select(*rows.columns, F.lit(None).cast("bigint").alias("group_size"), F.lit(None).cast(groups.schema["last"].dataType).alias("last"))
    return compared.unionByName(single).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("last.place") == F.col("place"), F.lit(True)).alias("kept"),
        *[F.col(f"carried.{n}").alias(n) for n in carry or {}],
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `mark_copies` keeps, with all their columns."""
    marked = mark_copies(docs, doc_id, text, {"row": F.struct(*[F.col(c) for c in docs.columns])})
    return marked.where("kept").select("row.*")
