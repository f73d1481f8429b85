"""SimHash near-duplicates found with tables of distances to reference fingerprints.

Copies are collapsed first: everything after the fingerprints works on distinct
ones. For each, the Hamming distances to fixed reference fingerprints (pivots)
are written once. Two uses are made of that table:

- By the triangle inequality, fingerprints at distance r differ by at most r in
  each coordinate, so a pair with a larger maximum difference is discarded.
- A pivot inside a block of bits, compared with the zero pivot, tells how many
  of its bits are set: the coordinate relative to that of zero depends on that
  block alone. At distance 2 or less at least two of four blocks are equal, so
  every linked pair agrees on the relative coordinates of two blocks. Only
  fingerprints that do so meet.

A bucket with more than `BUCKET` fingerprints is dealt out again by the bits
that are still free, now by single-bit pivots, at most three more times; then
four bits are free and a bucket holds 16 at most. No bucket is dropped or cut.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm import tokens
from brightwater.llm.common import map_arrow, row_key, write_shared
from brightwater.llm.components import components

#: Fingerprints in a bucket that are compared in pairs.
BUCKET = 64
RADIUS = 2
SHINGLE = 3
SEED = 42

_BLOCK_BITS = 16
_BLOCKS = 64 // _BLOCK_BITS
_PIVOTS_PER_BLOCK = 8


def _pivots() -> list[int]:
    """The zero fingerprint, then those of each block in turn."""
    draw = random.Random(64)
    found = [0]
    for block in range(_BLOCKS):
        for _ in range(_PIVOTS_PER_BLOCK):
            bits = draw.sample(range(_BLOCK_BITS), _BLOCK_BITS // 2)
            found.append(sum(1 << (block * _BLOCK_BITS + bit) for bit in bits))
    return found


PIVOTS = _pivots()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit values; see `fingerprints`."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for begin, part in tokens.slices(texts):
        words = tokens.split(part)
        counts = words.counts()
        values, first = [], np.zeros(len(part) + 1, np.int64)
        for d in range(len(part)):
            lo, hi = words.first[d], words.first[d + 1]
            if lo == hi:
                first[d + 1] = len(values)
                continue
            n = counts[d]
            spaced = bytes(words.data[words.starts[lo] : words.ends[hi - 1]]).lower().split()
            lengths = np.fromiter(map(len, spaced), np.int64, n)
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: max(n - SHINGLE + 1, 1)].tolist()
            joined = b" ".join(spaced)
            values += [digest(joined[s:e], SEED) for s, e in zip(starts, ends[min(n, SHINGLE) - 1 :].tolist())]
            first[d + 1] = len(values)
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            continue
        hashes = np.array(values, np.uint64)
        ones = np.zeros((len(full), 64), np.int64)
        for k, d in enumerate(full):
            bits = np.unpackbits(hashes[first[d] : first[d + 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] = bits.sum(axis=0, dtype=np.int32)
        majority = (2 * ones > np.diff(first)[full][:, None]).astype(np.uint8)
        out[begin + full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `doc_id` and `fp` (the fingerprint's bits as a bigint), one row per row of `docs`.

    A-Z are lower-cased. Shingles are runs of three words joined by spaces, the
    whole sequence where there are fewer; a bit is set if it is in over half
    the XXH64 values. Null texts and those without words have fingerprint zero.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def per_batch(batches):
        for batch in batches:
            bits = fingerprints_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint"
    return map_arrow(rows, per_batch, schema)


def _relative(block: int) -> list[Column]:
    """Distances to the pivots of a block, less the distance to the zero pivot."""
    k = 1 + block * _PIVOTS_PER_BLOCK
    return [F.col("far")[i] - F.col("far")[0] for i in range(k, k + _PIVOTS_PER_BLOCK)]


def _first_buckets(distinct: DataFrame) -> DataFrame:
    far = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("tinyint") for p in PIVOTS])
    buckets = [
        F.struct(
            F.xxhash64(F.lit(i), F.lit(j), *_relative(i), *_relative(j)).alias("key"),
            F.array(
                *[
                    F.lit(b * _BLOCK_BITS + bit).cast("tinyint")
                    for b in range(_BLOCKS)
                    if b not in (i, j)
                    for bit in range(_BLOCK_BITS)
                ]
            ).alias("free"),
        )
        for i, j in combinations(range(_BLOCKS), 2)
    ]
    return (
        distinct.withColumn("far", far)
        .select("fp", "far", F.explode(F.array(*buckets)).alias("bucket"))
        .select("fp", "far", "bucket.*")
    )


def _finer_buckets(rows: DataFrame) -> DataFrame:
    """Deals out buckets by two of four equal parts of their free bits."""
    size = (F.size("free") / 4).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("free", k * size + 1, size))

    def to_unit_pivots(part: Column) -> Column:
        return F.transform(
            part,
            lambda bit: F.bit_count(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))))
            - F.bit_count(F.col("fp")),
        )

    choices = [
        F.struct(
            F.xxhash64("key", F.lit(i), F.lit(j), to_unit_pivots(F.col("parts")[i]), to_unit_pivots(F.col("parts")[j])).alias("key"),
            F.concat(*[F.col("parts")[k] for k in range(4) if k not in (i, j)]).alias("free"),
        )
        for i, j in combinations(range(4), 2)
    ]
    return (
        rows.withColumn("parts", parts)
        .select("fp", "far", F.explode(F.array(*choices)).alias("bucket"))
        .select("fp", "far", "bucket.*")
    )


def within(a: Column, b: Column, radius: int) -> Column:
    """Whether two fingerprints differ in `radius` bits or fewer, after a look at their distances to each block's first pivot."""
    near = F.lit(True)
    for pivot in PIVOTS[:: _PIVOTS_PER_BLOCK]:
        far_a, far_b = (F.bit_count(x.bitwiseXOR(F.lit(_signed(pivot)))) for x in (a, b))
        near = near & (F.abs(far_a - far_b) <= radius)
    return near & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def _pairs(buckets: DataFrame) -> DataFrame:
    left = buckets.select("key", F.col("fp").alias("a"), F.col("far").alias("far_a"))
    right = buckets.select("key", F.col("fp").alias("b"), F.col("far").alias("far_b"))
    near = F.lit(True)
    for k in range(len(PIVOTS)):
        near = near & (F.abs(F.col("far_a")[k] - F.col("far_b")[k]) <= RADIUS)
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near & verified).select("a", "b")


def near_pairs(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs `a < b` of the distinct non-null bigint column `fp` that differ in one or two bits."""
    if bucket < 16:
        raise ValueError("a bucket of the last deal may hold 16 fingerprints")
    level = write_shared(_first_buckets(distinct), "buckets")
    found = None
    while True:
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = write_shared(sizes.where(F.col("n") > bucket).select("key"), "large")
        none_large = large.isEmpty()
        small = level.select("key", "fp", "far")
        if not none_large:
            small = small.join(large, "key", "left_anti")
        pairs = _pairs(small)
        found = pairs if found is None else found.union(pairs)
        if none_large:
            return found.distinct()
        level = write_shared(_finer_buckets(level.join(large, "key", "left_semi")), "buckets")


def _roots(rows: DataFrame) -> DataFrame:
    """Columns `fp` and `root` (the smallest fingerprint reached) of the distinct fingerprints of `rows`."""
    distinct = write_shared(rows.select("fp").distinct(), "distinct")
    linked = components(near_pairs(distinct)).withColumnRenamed("node", "fp")
    return write_shared(distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def with_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `doc_id`, `row_key` (of id and text), `fp` and `root`; rows with equal `root` are one group."""
    keys = docs.select(F.struct(doc_id, row_key(F.col(doc_id), F.col(text)).alias("row_key")).alias("key"), text)
    rows = write_shared(fingerprints(keys, "key", text), "fingerprints").select("doc_id.*", "fp").withColumnRenamed(doc_id, "doc_id")
    return rows.join(_roots(rows), "fp").select("doc_id", "row_key", "fp", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `doc_id`, `fingerprint` (16 lower-case hex digits) and `component_id`.

    One row per row of `docs`. Documents whose fingerprints differ in two bits
    or fewer are linked; `component_id` is the smallest doc_id that links lead
    to, the own one included. Null ids take part but are never the smallest; a
    component of null ids alone has a null `component_id`. Repeated rows and
    ids give repeated rows. An empty table gives no rows. Other columns of
    `docs` are not read.
    """
    rows = write_shared(fingerprints(docs, doc_id, text), "fingerprints")
    roots = _roots(rows)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    smallest = roots.join(first, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = write_shared(roots.join(smallest, "root").select("fp", "component_id"), "component-of")
    return rows.join(by_class, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
