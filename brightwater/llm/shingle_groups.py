"""Groups of texts whose sets of five-word shingles are similar by `LEAST` or more (Jaccard).

Texts with equal sets are one node, and only nodes meet. Candidates share the
whole content of a part of their sets: sets of sizes n and m that are similar
enough differ in at most (n + m) / 9 shingles, and are dealt by hash into one
part more than that, so some part is equal in both. Sizes are taken in classes
of a factor 1.5625; a set that may be similar to larger ones of the next class
takes part in that class too. Of many parts `PARTS` are written. At the bound
about a third are equal, so a pair misses all of them in about one of 50,000
cases; small sets are dealt several times, since an equal part may be empty.

Which candidates are near is told by SimHash alone, at two widths. Fingerprints
of 64 bits are discarded by the pivot distances of `simhash_pivots` and beyond
`RADIUS` bits; those of 1,024 bits by their distances to reference
fingerprints and beyond `WIDE_RADIUS` bits. Sets of under `FEW` shingles are
not discarded by that. An exact comparison of what is near follows.

Joins that carry sets or wide fingerprints are merge joins, so that these never
pass the driver for a broadcast, however few they are.

To keep this far below all pairs, in a first round each set is compared with one
other, the nearest by fingerprint of those that its parts have chosen as their
centres. So many near copies of one text cost a comparison each. The sets
of parts that are not in one group by then all meet within tasks, first as wide
fingerprints; only those that are near another there meet once more, as rows of
bits. Their pairs are never written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm import simhash_pivots, tokens
from brightwater.llm.bitmaps import bitmap_of, bits_for, marked, passing
from brightwater.llm.common import grouped_arrow, map_arrow, row_key, write_shared
from brightwater.llm.components import components
from brightwater.llm.group_joins import join_groups

SHINGLE = 5
#: Similarity of linked texts, as a fraction.
LEAST = (4, 5)
PARTS = 24
#: Bits of 64 that fingerprints of similar sets differ in at most; about ten are usual at the bound.
RADIUS = 24
#: Bits of 1,024 that wide fingerprints of similar sets differ in at most. For no sizes from `FEW` on is
#: the chance of a bit to differ over 0.1582, so 162 are expected at most and 220 are five deviations more.
WIDE_RADIUS = 220
#: Sets of fewer shingles are compared whatever their fingerprints.
FEW = 16
#: Rounds with centres before all pairs of different groups are looked at.
ROUNDS = 1
#: Reference fingerprints of a block of sets that meet, the first ones there.
REFERENCES = 8
#: Sets of a part in one block, shingles in one block, and partners that share one copy of a set.
MEET, CELLS, PARTNERS = 1024, 1_000_000, 64
_WIDTH = 1.5625
_STEP = np.uint64(0xD1B54A32D192ED03)
_STEP_2 = np.uint64(0xA24BAED4963EE407)
_WORDS = 16
_STEPS = tokens.mix(np.arange(1, _WORDS + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased; fewer than five words are one shingle."""
    for _, part in tokens.slices(texts):
        words = tokens.split(part)
        data = words.data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        words.data = data
        hashes = tokens.word_hashes(words)
        grams = tokens.mix(tokens.rolling(hashes, SHINGLE))
        for lo, hi in zip(words.first[:-1], words.first[1:]):
            n = int(hi - lo)
            if n >= SHINGLE:
                yield np.unique(grams[lo : hi - SHINGLE + 1])
            else:
                yield tokens.mix(tokens.rolling(hashes[lo:hi], n) + np.uint64(n)) if n else np.zeros(0, np.uint64)


def set_ids(found: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two independent hashes of a set."""
    n = np.uint64(len(found))
    sums = np.array([tokens.mix(found + step).sum(dtype=np.uint64) + n for step in (_STEP, _STEP_2)], np.uint64)
    first, second = tokens.mix(sums)
    return first, second


def fingerprint(found: np.ndarray) -> np.uint64:
    """SimHash of a set: the bits that over half of its hashes have."""
    bits = np.unpackbits(tokens.mix(found ^ _STEP).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(found)
    return np.packbits(majority, bitorder="little").view(np.uint64)[0]


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of a set over 16 hashes of each shingle, as 16 words of 64 bits."""
    ones = np.zeros(64 * _WORDS, np.int64)
    for begin in range(0, len(found), 255):
        hashes = tokens.mix(found[begin : begin + 255, None] ^ _STEPS)
        ones += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def signatures(found: np.ndarray) -> np.ndarray:
    """Hashes of the parts of a set, for its own size class and, where similar sets may be there, the next."""
    n = len(found)
    if not n:
        return found
    own = math.floor(math.log(n) / math.log(_WIDTH) + 1e-9)
    content = tokens.mix(found + _STEP)
    out = []
    for level in (own, own + 1):
        if level > own and n * 1.25 < _WIDTH**level - 1e-6:
            break
        parts = int(2 * _WIDTH ** (level + 1) / 9) + 1
        for deal in range(max(1, min(8, PARTS // parts))):
            salt = tokens.mix(np.array([level * 16 + deal + 1], np.uint64))[0]
            at = tokens.mix(found ^ salt) % np.uint64(parts)
            chosen = np.flatnonzero(at < PARTS)
            if not len(chosen):
                continue
            order = chosen[np.argsort(at[chosen], kind="stable")]
            ranked = at[order]
            begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            out.append(tokens.mix(np.add.reduceat(content[order], begins) ^ tokens.mix(ranked[begins] + salt)))
    return np.concatenate(out) if out else found[:0]


def _signed(rows: DataFrame) -> DataFrame:
    """`doc_id`, `row_key`, `id`, `second`, `n`, `fp`, `wide` and `signs` of rows with `doc_id`, `row_key` and `text`."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                ids, sizes, wide, signs = [], [], [], []
                for found in shingle_sets(part.column("text")):
                    ids.append((*set_ids(found), fingerprint(found)))
                    sizes.append(len(found))
                    wide.append(wide_fingerprint(found).view(np.int64))
                    signs.append(signatures(found).view(np.int64))
                id_, second, fp = np.array(ids, np.uint64).view(np.int64).reshape(-1, 3).T
                columns = [id_, second, np.array(sizes, np.int32), fp]
                columns = [part.column("doc_id"), part.column("row_key"), *map(pa.array, columns), *[pa.array(x, pa.list_(pa.int64())) for x in (wide, signs)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "id", "second", "n", "fp", "wide", "signs"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row_key bigint, id bigint, second bigint, n int, fp bigint, wide array<bigint>, signs array<bigint>"
    return map_arrow(rows, per_batch, schema)


def _told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`signed` with different sets under different ids, and one row per set with the `key` of a row that has it."""

    def nodes_of(rows: DataFrame) -> DataFrame:
        one = [F.first(c).alias(c) for c in rows.columns if c not in ("doc_id", "row_key", "id", "second")]
        ends = [F.min("second").alias("low"), F.max("second").alias("high"), F.min("row_key").alias("key")]
        return write_shared(rows.groupBy("id").agg(*one, *ends), "nodes")

    nodes = nodes_of(signed)
    clash = nodes.where("low != high")
    if not clash.isEmpty():
        # the other hash takes over for sets that share the first
        clash = clash.select("id", F.lit(True).alias("clash"))
        signed = write_shared(
            signed.join(clash, "id", "left").select(
                *[F.when(F.col("clash"), F.col("second")).otherwise(F.col("id")).alias("id") if c == "id" else c for c in signed.columns]
            ),
            "signed",
        )
        nodes = nodes_of(signed)
    return signed, nodes.drop("low", "high")


def _may_be_similar(a: str, b: str) -> Column:
    """Whether sizes and fingerprints of nodes with suffixes `a` and `b` allow a similarity of `LEAST`."""
    part, whole = LEAST
    n_a, n_b, fp_a, fp_b = (F.col(c) for c in (f"n{a}", f"n{b}", f"fp{a}", f"fp{b}"))
    sizes = (n_a * whole >= n_b * part) & (n_b * whole >= n_a * part)
    return sizes & ((F.least(n_a, n_b) < FEW) | simhash_pivots.within(fp_a, fp_b, RADIUS))


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs `a`, `b` whose wide fingerprints allow a similarity of `LEAST`."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")).hint("merge"), c)
    bits = [F.bit_count(F.col("wide_a")[i].bitwiseXOR(F.col("wide_b")[i])) for i in range(_WORDS)]
    return both.where((F.least("n_a", "n_b") < FEW) | (sum(bits[1:], bits[0]) <= WIDE_RADIUS)).select("a", "b")


def _sets(ids: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """`id` and `shingles` of the sets with the distinct `ids`, from the texts of `rows` that have them."""
    wanted = write_shared(nodes.select("id", "key").join(ids.hint("merge"), "id"), "wanted")
    texts = passing(rows.select(F.col("row_key").alias("key"), "text"), wanted.select("key"), "key")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                part = batch.slice(begin, 64)
                found = list(shingle_sets(part.column("text")))
                ids = np.array([set_ids(s) for s in found], np.uint64).view(np.int64).reshape(-1, 2)
                columns = [part.column("key"), *map(pa.array, ids.T), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "first", "second", "shingles"])

    found = map_arrow(texts, per_batch, "key bigint, first bigint, second bigint, shingles array<bigint>")
    own = (F.col("id") == F.col("first")) | (F.col("id") == F.col("second"))
    # rows with equal id and text are alike, so any one of them will do
    found = found.join(wanted.hint("merge"), "key").where(own).groupBy("key", "id").agg(F.first("shingles").alias("shingles"))
    return write_shared(found.select("id", "shingles"), "sets")


def _similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the written pairs `a`, `b` whose sets are similar enough.

    The set with more partners is copied once for every `PARTNERS` of them.
    """
    sets = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), nodes, rows)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("of"))
    ends = write_shared(ends, "partners")
    both = pairs.join(ends.toDF("a", "of_a"), "a").join(ends.toDF("b", "of_b"), "b")
    more = F.col("of_a") >= F.col("of_b")
    both = both.select(
        F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("leaf"),
        F.ceil(F.greatest("of_a", "of_b") / PARTNERS).alias("deals"),
    )
    both = write_shared(both.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.col("deals")).alias("deal")), "pairs")
    left = both.select("hub", "deal").distinct().join(sets.toDF("hub", "x").hint("merge"), "hub")
    right = both.join(sets.toDF("leaf", "y").hint("merge"), "leaf")
    common = F.size(F.array_intersect("x", "y"))
    part, whole = LEAST
    same = left.join(right.hint("merge"), ["hub", "deal"]).where(common * whole >= (F.size("x") + F.size("y") - common) * part)
    return write_shared(same.select(F.col("hub").alias("a"), F.col("leaf").alias("b")), "similar")


def _members(nodes: DataFrame) -> DataFrame:
    """`sign`, `id`, `n` and `fp` of the sets that share a part with another."""
    exploded = nodes.select("id", "n", "fp", F.explode("signs").alias("sign"))
    shared = exploded.groupBy("sign").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most")
    shared = write_shared(shared.select("sign"), "shared")
    # a part on the bit of a shared one may pass too; it has one set and leads to no pair
    return write_shared(passing(exploded, shared, "sign"), "members")


def _apart(members: DataFrame, roots: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """The members of parts that several groups share, with `root`, and one centre per part, another each turn."""
    if roots is None:
        placed = members.withColumn("root", F.col("id"))
    else:
        placed = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        placed = write_shared(placed, "placed")
    turned = placed.withColumn("h", F.xxhash64("id", F.lit(turn)))
    chosen = [F.min_by(c, "h").alias(f"{c}_c") for c in ("id", "n", "fp", "root")]
    centres = turned.groupBy("sign").agg(*chosen, F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("widest"), F.count(F.lit(1)).alias("sets"))
    centres = write_shared(centres.where("low != high").drop("low", "high"), "centres")
    kept = write_shared(join_groups(placed, centres, ["sign"], "sets"), "apart")
    return kept, centres


def links_within(ids, roots, sizes, blocks, sets, two_blocks: bool) -> list[tuple[int, int]]:
    """Links that join the groups of sets which are similar enough, as few as will do.

    `sets` are arrays of hashes. With `two_blocks` only sets of different
    blocks meet. The hashes that two sets or more have become columns, and a
    row of bits per set is compared with those of all later sets at once.
    """
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = np.repeat(np.arange(len(sets)), list(map(len, sets)))[shared], place[column[shared]]
    width = int(place[-1]) // 64 + 1 if len(place) else 1
    bits = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(bits.ravel(), row * width + column // 64, np.uint64(1) << (column % 64).astype(np.uint64))
    label = np.unique(roots, return_inverse=True)[1]
    part, whole = LEAST
    found = []
    for r in range(len(sets) - 1):
        later = np.arange(r + 1, len(sets))
        meets = (label[later] != label[r]) & (sizes[later] * whole >= sizes[r] * part) & (sizes[r] * whole >= sizes[later] * part)
        if two_blocks:
            meets &= blocks[later] != blocks[r]
        later = later[meets]
        for begin in range(0, len(later), 256):
            others = later[begin : begin + 256]
            common = np.bitwise_count(bits[others] & bits[r]).sum(axis=1, dtype=np.int64)
            for c in others[common * whole >= (sizes[others] + sizes[r] - common) * part].tolist():
                if label[c] != label[r]:
                    found.append((int(ids[r]), int(ids[c])))
                    label[label == label[c]] = label[r]
    return found


def near_another(roots, sizes, blocks, wide, two_blocks: bool) -> np.ndarray:
    """Whether each set has one of another group near it, by sizes and wide fingerprints.

    Distances to the reference fingerprints are tabled first. By the triangle
    inequality those of near ones differ by `WIDE_RADIUS` at most in each.
    """
    part, whole = LEAST
    far = np.stack([np.bitwise_count(wide ^ w).sum(axis=1, dtype=np.int16) for w in wide[:REFERENCES]], axis=1)
    near = np.zeros(len(wide), bool)
    for r in range(len(wide) - 1):
        later = np.arange(r + 1, len(wide))
        meets = (roots[later] != roots[r]) & (sizes[later] * whole >= sizes[r] * part) & (sizes[r] * whole >= sizes[later] * part)
        if two_blocks:
            meets &= blocks[later] != blocks[r]
        if near[r]:
            meets &= ~near[later]
        few = np.minimum(sizes[later], sizes[r]) < FEW
        later = later[meets & (few | (np.abs(far[later] - far[r]) <= WIDE_RADIUS).all(axis=1))]
        few = np.minimum(sizes[later], sizes[r]) < FEW
        later = later[few | (np.bitwise_count(wide[later] ^ wide[r]).sum(axis=1, dtype=np.int16) <= WIDE_RADIUS)]
        near[later] = True
        near[r] |= len(later) > 0
    return near


def _near_in_parts(dealt: DataFrame) -> DataFrame:
    """The rows of `dealt`, without `wide`, of sets that are near another of their `sign`, `i` and `j`."""

    def judged(table: pa.Table, begins: np.ndarray, number: dict[str, np.ndarray]) -> pa.RecordBatch:
        flat = table.column("wide").combine_chunks()
        wide = flat.flatten().to_numpy().view(np.uint64).reshape(-1, _WORDS)
        keep = np.zeros(len(table), bool)
        for lo, hi in zip(begins, [*begins[1:], len(table)]):
            own = slice(lo, hi)
            two = number["i"][lo] != number["j"][lo]
            keep[own] = near_another(number["root"][own], number["n"][own], number["block"][own], wide[own], two)
        kept = table.drop_columns(["wide"]).filter(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], kept.column_names)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            if not len(table):
                continue
            number = {c: table.column(c).to_numpy().astype(np.int64) for c in ("sign", "i", "j", "block", "n", "root")}
            new = np.logical_or.reduce([number[c][1:] != number[c][:-1] for c in ("sign", "i", "j")])
            begins = np.flatnonzero(np.r_[True, new])
            # the last group may go on in the next batch
            if begins[-1]:
                yield judged(table.slice(0, begins[-1]), begins[:-1], number)
            rest = table.slice(begins[-1])
        if rest is not None:
            yield judged(rest, np.zeros(1, np.int64), {c: rest.column(c).to_numpy().astype(np.int64) for c in ("i", "j", "block", "n", "root")})

    kept = ["sign", "i", "j", "block", "id", "n", "root"]
    grouped = dealt.select(*kept, "wide").repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j")
    return map_arrow(grouped, per_batch, "sign bigint, i int, j int, block int, id bigint, n int, root bigint")


def _meet(apart: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Links `a`, `b` of sets that share a part and are of different groups, if there may be any: all meet, and no pairs are written.

    A part with many sets, or large ones, is cut into blocks that meet in pairs,
    each in a task of bounded memory. Sets that are near no other by their wide
    fingerprints leave before any shingle moves. Shingles are compared by 31
    bits of their hashes.
    """
    apart = apart.select("sign", "id", "n", "root", "sets", "widest")
    block = F.greatest(F.lit(2), F.least(F.lit(MEET), (F.lit(CELLS) / F.col("widest")).cast("int")))
    dealt = apart.withColumn("blocks", F.ceil(F.col("sets") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sign", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "root")
    near = write_shared(_near_in_parts(dealt.join(nodes.select("id", "wide").hint("merge"), "id")), "near")
    if near.isEmpty():
        return None
    sets = _sets(near.select("id").distinct(), nodes, rows)
    sets = sets.select("id", F.transform("shingles", lambda h: h.bitwiseAND((1 << 31) - 1).cast("int")).alias("shingles"))

    def per_group(group: pa.Table) -> pa.Table:
        ids, roots, sizes, blocks = (group.column(c).to_numpy().astype(np.int64) for c in ("id", "root", "n", "block"))
        sets = [s.values.to_numpy() for s in group.column("shingles").combine_chunks()]
        two = group.column("i")[0] != group.column("j")[0]
        found = np.array(links_within(ids, roots, sizes, blocks, sets, two), np.int64).reshape(-1, 2)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    links = grouped_arrow(near.join(sets.hint("merge"), "id"), ["sign", "i", "j"], per_group, "a bigint, b bigint")
    return write_shared(links.distinct(), "similar")


def with_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `doc_id`, `row_key` (of id and text) and `root`; rows with equal `root` are one group.

    One row per row of `docs`, a written table. Texts without words, nulls
    included, are one group. A-Z are lower-cased; texts of fewer than five
    words have one shingle. Null ids are ids like others, and repeated rows are
    one set. Very long texts take part whole. A similarity of exactly `LEAST`
    links. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).alias("text"))
    signed, nodes = _told_apart(write_shared(_signed(rows), "signed"))
    apart, roots, links = _members(nodes), None, None
    for turn in range(ROUNDS + 1):
        apart, centres = _apart(apart, roots, turn)
        if centres.isEmpty():
            break
        if turn == ROUNDS:
            found = _meet(apart, nodes, rows)
            if found is not None and not found.isEmpty():
                roots = components(found if links is None else links.union(found))
            break
        near = apart.where((F.col("root") != F.col("root_c")) & _may_be_similar("", "_c"))
        bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_c")))
        pairs = near.groupBy("id").agg(F.min_by("id_c", F.struct(bits, "id_c")).alias("centre"))
        pairs = pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        pairs = write_shared(_near(pairs, nodes), "candidates")
        if not pairs.isEmpty():
            found = _similar(pairs, nodes, rows)
            links = found if links is None else links.union(found)
            roots = components(links)
        apart = apart.select("sign", "id", "n", "fp")
    found = signed.select("doc_id", "row_key", "id")
    if roots is None:
        return found.withColumnRenamed("id", "root")
    rows_of = signed.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("id", "node")
    sized = write_shared(roots.join(rows_of, "node").withColumnRenamed("node", "id"), "rooted")
    found = join_groups(found, sized, ["id"], "rows", "left")
    return found.select("doc_id", "row_key", F.coalesce("root", "id").alias("root"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of linked rows of `docs` the one with the smallest id, with all its columns.

    Rows with a null id are kept only if no row of their group has an id. Of
    rows that share the smallest id, or of null ids alone, the one with the
    smallest hash of id and text is kept, once. `docs` should be a written
    table. An empty table gives no rows.
    """
    found = write_shared(with_groups(docs, doc_id, text), "groups")
    # ids are compared by their order, so any type will do
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    first = found.groupBy("root").agg(best, F.count(F.lit(1)).alias("rows"))
    first = write_shared(first.select("root", F.col("first.row_key").alias("first_key"), "rows"), "first")
    placed = join_groups(found.select("root", "row_key"), first, ["root"], "rows")
    # keys of rows that go, and of those that are there more than once
    counted = placed.groupBy("row_key").agg(F.min(F.col("row_key") == F.col("first_key")).alias("stays"), F.count(F.lit(1)).alias("times"))
    doubtful = write_shared(counted.where("NOT stays OR times > 1"), "doubtful")

    whole = docs.select(F.struct("*").alias("doc"), row_key(F.col(doc_id), F.col(text)).alias("row_key"))
    keys = write_shared(doubtful.select("row_key"), "doubtful-keys")
    bits = bits_for(keys.count())
    whole = marked(whole, "row_key", bitmap_of(keys, "row_key", bits), bits, "in_doubt")
    suspects = join_groups(whole.where("in_doubt").drop("in_doubt"), doubtful, ["row_key"], "times", "left", found.count())
    stay = suspects.where("stays IS NULL").select("doc")
    # a key that is there more than once may have any number of rows, so they are made one before they meet
    once = suspects.where("stays").groupBy("row_key").agg(F.first("doc").alias("doc")).select("doc")
    return whole.where("NOT in_doubt").select("doc").unionByName(stay).unionByName(once).select("doc.*")
