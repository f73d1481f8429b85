"""Benchmark passages in documents, by SimHash of item-sized windows.

Built-in expressions and joins only. Words are lower-cased runs of letters and
digits, shingles five of them in a row, each hashed to 64 bits.

1. Windows. A window is as long as an item. A window similar to an item shares
   a shingle with it, so windows are laid where a shingle of the document is
   also one of an item: the item's length, with the shingle in the same place.
   A window keeps the items whose shingles laid it.
2. Fingerprints. A bit of the SimHash is set if more than half the window's
   shingles have it, repeats included.
3. Multi-index. Fingerprints of `RADIUS + 1` blocks that differ in `RADIUS`
   bits or fewer agree in a block. A window asks for such blocks among its own
   items alone, since at this radius blocks are 2 or 3 bits wide and would
   propose nearly any other item too. Equal windows ask once.
4. Verification. The weighted Jaccard similarity of the shingles, which counts
   a repeated shingle as often as it occurs, is exact. It is computed once for
   equal windows and dealt to documents by `join_groups`, so a passage that a
   third of all documents hold is not one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm.bitmaps import passing
from brightwater.llm.common import let, row_key, write_shared
from brightwater.llm.group_joins import join_groups

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which a window may differ from an item. At the similarity above, nine to ten
#: differ on average; over 24 differ in fewer than one of 50,000 windows.
RADIUS = 24
#: Rows of the benchmark's shingles, of fixed width, that are sent to all executors.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", -1), lambda w: w != "")


def _shingles(words: Column) -> Column:
    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        places = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[hashes[i + k] for k in range(SHINGLE)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _simhash(shingles: Column) -> Column:
    """`shingles` is a column, not an expression to be evaluated."""
    ones = F.aggregate(
        shingles,
        F.array_repeat(F.lit(0), 64),
        lambda sums, h: F.transform(sums, lambda c, b: c + F.getbit(h, b)),
        lambda sums: F.transform(sums, lambda c: (2 * c > F.size(shingles)).cast("bigint")),
    )
    return F.aggregate(
        F.zip_with(ones, F.sequence(F.lit(0), F.lit(63)), lambda c, b: F.call_function("shiftleft", c, b)),
        F.lit(0).cast("bigint"),
        lambda bits, b: bits.bitwiseOR(b),
    )


def _counted(shingles: Column) -> Column:
    """The k-th occurrence of a shingle as a value of its own, so that a set holds the repeats."""

    def of(ordered: Column) -> Column:
        return F.transform(ordered, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(ordered, h)))

    return let(F.sort_array(shingles), of)


def _blocks(fp: str, radius: int) -> Column:
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint")).alias("value"),
            )
            for k, (low, high) in enumerate(zip(edges, edges[1:]))
        ]
    )


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A table of fixed-width rows, to be broadcast if it is sure to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per wording: `wording` (a hash of it), `item_id` (the smallest), `length`, `shingles`, `fp`."""
    worded = benchmark.select(F.col("item_id"), _words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    return (
        worded.groupBy("words")
        .agg(F.min("item_id").alias("item_id"))
        .select(F.xxhash64("words").alias("wording"), "item_id", F.size("words").alias("length"), _shingles(F.col("words")).alias("shingles"))
        .withColumn("fp", _simhash(F.col("shingles")))
    )


def _windows(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """Windows as they lie in documents: `start`, `in_window` (shingles), `fp`, `content` (a hash) and `items` (wordings)."""
    first_place = F.transform(
        F.array_distinct("shingles"), lambda h: F.struct(h.alias("shingle"), (F.array_position("shingles", h) - 1).cast("int").alias("place"))
    )
    anchors = items.select("wording", "length", F.explode(first_place).alias("anchor")).select("wording", "length", "anchor.*")
    anchors = _bounded(write_shared(anchors, "anchors"), broadcast_rows)

    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    hits = (
        rows.select("doc_id", "row_key", _shingles(_words(F.col("text"))).alias("shingles"))
        .select("doc_id", "row_key", F.size("shingles").alias("n"), F.posexplode("shingles").alias("at", "shingle"))
        .join(anchors, "shingle")
    )
    last = F.greatest(F.col("n") + SHINGLE - 1 - F.col("length"), F.lit(0))
    windows = (
        hits.select("doc_id", "row_key", F.least(F.greatest(F.col("at") - F.col("place"), F.lit(0)), last).alias("start"), "length", "wording")
        .groupBy("doc_id", "row_key", "start", "length")
        .agg(F.sort_array(F.collect_set("wording")).alias("items"))
        .groupBy("doc_id", "row_key")
        .agg(F.collect_list(F.struct("start", "length", "items")).alias("windows"))
    )
    windows = write_shared(windows, "windows").select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "windows")

    texts = rows.join(windows, (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    found = (
        texts.select("doc_id", "row_key", "windows", _shingles(_words(F.col("text"))).alias("all"))
        .select("doc_id", "row_key", "all", F.explode("windows").alias("w"))
        .select(
            "doc_id", "row_key", "w.start", "w.items",
            F.slice("all", F.col("w.start") + 1, F.col("w.length") - SHINGLE + 1).alias("in_window"),
        )
        .distinct()
        .withColumn("fp", _simhash(F.col("in_window")))
        .withColumn("content", F.xxhash64("in_window"))
    )
    return write_shared(found, "windows-hashed")


def _near(asked: DataFrame, items: DataFrame, radius: int, broadcast_rows: int) -> DataFrame:
    """The rows of `asked` (`fp`, `wording` and others) within the radius of that item, with `hamming`."""
    coded = items.select(F.col("fp").alias("item_fp"), "wording", F.explode(_blocks("fp", radius)).alias("b"))
    coded = _bounded(write_shared(coded.select("item_fp", "wording", "b.*"), "item-blocks"), broadcast_rows)
    probes = asked.select("fp", "wording").distinct().select("fp", "wording", F.explode(_blocks("fp", radius)).alias("b"))
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = probes.select("fp", "wording", "b.*").join(coded, ["wording", "block", "value"]).where(hamming <= radius)
    return asked.join(near.select("fp", "wording", hamming.alias("hamming")).distinct(), ["fp", "wording"])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The best window of each document for each item that it holds.

    Columns `doc_id`, `row_key` (of id and text), `item_id`, `start` (words,
    from 0), `n_words`, `hamming` and `similarity`; at equal similarity the
    first window. Documents without a match have no row. Items with the same
    words count once, under their smallest id; wordings that share an id give
    the best of them, and an item with a null id is reported with it. Items and
    documents of fewer than five words match nothing, null and empty texts
    neither. In a document shorter than an item, its whole text is the window.
    A very long text is taken whole. Rows with a null id are reported with it,
    repeated rows once. Empty tables give no rows. Other columns are not read.
    """
    items = write_shared(_items(benchmark), "items")
    found = _windows(docs, items, broadcast_rows)
    asked = found.select("fp", "content", F.explode("items").alias("wording"))
    asked = asked.groupBy("fp", "content", "wording").agg(F.count(F.lit(1)).alias("copies"))
    near = write_shared(_near(write_shared(asked, "asked"), items, radius, broadcast_rows), "near")

    hopeful = write_shared(near.select("content").distinct(), "hopeful")
    contents = passing(found, hopeful, "content").groupBy("fp", "content").agg(F.first("in_window").alias("in_window"))
    wanted = items.select("wording", "item_id", F.col("shingles").alias("of_item"))
    shared = F.size(F.array_intersect(_counted(F.col("in_window")), _counted(F.col("of_item"))))
    similar = (
        near.join(contents, ["fp", "content"])
        .join(wanted, "wording")
        .withColumn("shared", shared)
        .withColumn("union", F.size("in_window") + F.size("of_item") - F.col("shared"))
        .where(F.col("shared") >= similarity * F.col("union") - 1e-9)
        .select("fp", "content", "wording", "copies", "item_id", "hamming", (F.col("shared") / F.col("union")).alias("similarity"))
    )
    similar = write_shared(similar, "similar")

    held = passing(found, write_shared(similar.select("content").distinct(), "held"), "content")
    n_words = (F.size("in_window") + SHINGLE - 1).alias("n_words")
    held = write_shared(held.select("doc_id", "row_key", "start", n_words, "fp", "content", F.explode("items").alias("wording")), "held-rows")
    scored = join_groups(held, similar, ["fp", "content", "wording"], "copies")
    best = F.max(
        F.struct(F.col("similarity"), (-F.col("start")).alias("before"), F.col("n_words"), (-F.col("hamming")).alias("closer"))
    )
    return (
        scored.groupBy("doc_id", "row_key", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_id", "row_key", "item_id", (-F.col("best.before")).alias("start"), "best.n_words",
            (-F.col("best.closer")).alias("hamming"), "best.similarity",
        )
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item; see `find_leaks`."""
    leaks = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    leaks = write_shared(leaks.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).distinct(), "leaks")
    same = (row_key(docs["doc_id"], docs["text"]) == leaks["key"]) & docs["doc_id"].eqNullSafe(leaks["id"])
    return docs.join(leaks, same, "left_anti")
