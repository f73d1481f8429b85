"""Mixing sources to target shares of words by entropy balancing.

Each document gets a rate, the expected number of times that the mix takes it.
Among all rates whose words add up to the target of every source, those are
chosen that are closest in entropy to taking each document once. They are
exponentially tilted by size: rate = exp(tilt * size / mean size of the
source), held at two. The tilts solve the convex dual, one for each source, by
Newton iterations that all sources go through together. An iteration is a
Spark aggregation over the numbers of documents by source and size, which are
counted once, so it does not read documents again and no source is one group.

Rates become copies: the whole part of the rate, and one more copy for those
documents whose hash lies furthest below the fraction. How many is settled for
each source by three rounds of histograms, so that less than one document is
missing; the document nearest in size to that is then taken once more. Rows that
share source, id and size are numbered, and the number is part of the hash, so
repeated rows and null ids get copies one by one. Sums are of integers or
decimals, so the result does not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightwater.llm.common import words, write_shared

WEIGHTS = (3, 1, 2)
#: Words of the mix in percent of all words, and most of a source or document.
SHARE_PERCENT = 150
MOST = 2
#: Newton rounds; from `_HALVING` on every other one halves the bounds, so any tilt is reached well before the last.
_ROUNDS, _HALVING = 200, 20
_TOLERANCE = 1e-6
_BINS = 1024
#: Sources, of short fixed width once numbered, that are sent to all executors.
BROADCAST_ROWS = 1_000_000
_SALTS = 32
#: Repeated rows that one row is unfolded to at a time.
_REPEATS = 10_000


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds `rank`, the place by code point from 0, null last, with no single task for all sources."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), F.col("source").cast("binary"))
    ordered = write_shared(
        ordered.sortWithinPartitions(F.col("source").isNull(), F.col("source").cast("binary")).select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
        ),
        "sources",
    )
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", "first", before.alias("before"))
    return ordered.join(F.broadcast(parts), "part").select(
        *sources.columns, (F.col("before") + F.col("place") - F.col("first")).alias("rank")
    )


def _targets(sources: DataFrame, weights, share_percent: int, most: int) -> DataFrame:
    """Adds `target`: shares by weight, with what a full source cannot take reshared until none is above."""
    each = F.array(*map(F.lit, weights))
    sources = sources.withColumn("weight", F.try_element_at(each, (F.col("rank") % len(weights) + 1).cast("int")))
    total = sources.agg(F.sum("source_size").cast("decimal(38,0)").alias("n")).first()["n"] or 0
    level, full = None, None
    while True:
        is_full = F.lit(False) if level is None else F.col("weight") * level >= most * F.col("source_size")
        sums = sources.agg(
            F.sum(F.when(is_full, F.col("source_size"))).alias("size"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("weight"),
            F.count(F.when(is_full, F.lit(1))).alias("full"),
        ).first()
        if not sums["weight"]:
            return sources.withColumn("target", (most * F.col("source_size")).cast("double"))
        if sums["full"] == full:
            target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
            return sources.withColumn("target", target)
        full = sums["full"]
        level = float((share_percent * total - 100 * most * (sums["size"] or 0)) / (100 * sums["weight"]))


def _rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    return F.when(size == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))
    )


def _exact(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def _tilts(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Columns `rank`, `mean`, `target` and `tilt`, by guarded Newton steps on the dual of every source.

    A tilt is kept between bounds that close in; a step beyond them is halved
    into their middle. A source that must be taken in full needs no tilt. A
    source that is still unsolved after the last round raises an error.
    """
    begin = sources.select(
        "rank", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.lit(0.0).alias("tilt"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
        ((F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size"))).alias("done"),
    )
    state = write_shared(
        begin.withColumn("tilt", F.when(F.col("done"), F.when(F.col("target") > 0, F.lit(1e6)).otherwise(F.lit(-1e6))).otherwise(0.0)),
        "tilts",
    )
    for turn in range(_ROUNDS + 1):
        unsolved = state.where(~F.col("done"))
        if unsolved.isEmpty():
            break
        if turn == _ROUNDS:
            raise ArithmeticError(f"no tilt was found for {unsolved.count()} sources in {_ROUNDS} rounds")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        words_taken = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, words_taken * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (
            sizes.join(state.where(~F.col("done")), "rank")
            .groupBy("rank")
            .agg(_exact(words_taken).alias("taken"), _exact(slope).alias("slope"))
        )
        moved = state.join(sums, "rank", "left")
        over = F.col("taken") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") + F.try_divide(F.col("target") - F.col("taken"), F.col("slope"))
        # beyond the bounds, towards the middle; a far bound is approached by a factor
        middle = (low + high) / 2
        middle = F.when(high >= 1e6, F.greatest(low, F.lit(0.0)) * 2 + 1).when(low <= -1e6, F.least(high, F.lit(0.0)) * 2 - 1).otherwise(middle)
        inside = step.isNotNull() & (step > low) & (step < high) & F.lit(turn < _HALVING or turn % 2 == 0)
        near = F.abs(F.col("taken") - F.col("target")) <= _TOLERANCE * F.col("target")
        still = F.col("done") | near | (high - low < 1e-12 * F.greatest(F.lit(1.0), F.abs(low), F.abs(high)))
        moved = moved.select(
            "rank", "target", "mean",
            F.when(still, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            still.alias("done"),
        )
        state = write_shared(moved, "tilts")
    return state.select("rank", "mean", "target", "tilt")


def _with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """`rows` joined by `rank`; a source with a third of all rows is met by copies of its one row."""
    if few:
        return rows.join(F.broadcast(sources), "rank")
    salted = rows.withColumn("salt", F.pmod(_hash(), F.lit(_SALTS)).cast("int"))
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(copies, ["rank", "salt"]).drop("salt")


def _hash() -> Column:
    return F.xxhash64("doc_id", "size", "nth")


def _told_apart(rows: DataFrame, names: DataFrame) -> DataFrame:
    """`rank`, `doc_id`, `size` and `nth` of rows: those that share source, id and size are numbered from 0.

    They are counted before the shuffle and unfolded again in blocks that are
    dealt over all partitions, so a third of all rows may be alike.
    """
    key = ["doc_id", "size"]
    counted = rows.groupBy("source", *key).agg(F.count(F.lit(1)).alias("n"))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(_SALTS)).cast("int"))
    copies = names.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    same = F.col("source").eqNullSafe(F.col("name")) & (F.col("salt") == F.col("copy"))
    counted = write_shared(salted.join(copies, same).select("rank", *key, "n"), "counted")
    once = counted.where("n = 1").select("rank", *key, F.lit(0).cast("bigint").alias("nth"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _REPEATS))
    many = counted.where("n > 1").withColumn("block", F.explode(blocks))
    # a number of partitions that is given is not reduced at run time: the rows are few, what they unfold to is not
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.repartition(partitions, "rank", *key, "block")
    begin = F.col("block") * _REPEATS
    nth = F.sequence(begin, F.least(begin + _REPEATS, F.col("n")) - 1)
    return once.unionByName(many.select("rank", *key, F.explode(nth).alias("nth")))


def mix(
    docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Columns `doc_id`, `size`, `source_size`, `target`, `taken`, `copies` and `rate`; one row per row of `docs`.

    Sizes count words. Sources by code point, null last, weigh `weights` over
    and over, and share `share_percent` of all words; a target stops at `most`
    times its source's words. `taken` is size times `copies`, and `copies` is
    at most `most`. A null text has no words and is not taken. Null and
    repeated ids and repeated rows count as documents of their own: of rows
    with equal source, id and size some may be taken once more than others,
    and which of them is not told. Ties in size go by a hash of id, size and
    that number. Very long texts are counted whole. If there are no words all
    targets are zero; an empty table gives no rows. Other columns of `docs` are
    not read.
    """
    rows = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"))
    rows = write_shared(rows, "sizes")
    by_size = write_shared(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by-size")
    sources = by_size.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    sources = write_shared(_targets(write_shared(_numbered(sources), "numbered"), weights, share_percent, most), "targets")
    few = sources.count() <= broadcast_rows
    names = sources.select(F.col("source").alias("name"), "rank")
    same = F.col("source").eqNullSafe(F.col("name"))
    sizes = write_shared(by_size.join(names, same).select("rank", "size", "n"), "by-rank")
    tilts = write_shared(_tilts(sizes, sources, most).join(sources.select("rank", "source_size"), "rank"), "solved")

    numbered = _told_apart(rows, names)
    rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
    rated = _with_source(numbered, tilts, few).withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    # how far below the fraction the hash lies: the smallest values get a further copy first
    draw = F.pmod(_hash(), F.lit(1 << 40)) / float(1 << 40)
    rated = rated.withColumn("place", F.when(F.col("rate") > F.col("whole"), (draw - F.col("rate") + F.col("whole") + 1) / 2))
    rated = write_shared(rated, "rated")

    # the place up to which copies are added, narrowed down by histograms
    base = rated.groupBy("rank").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    cut = tilts.join(base, "rank", "left").select(
        "rank", (F.col("target") - F.col("base")).alias("missing"), F.lit(0).cast("bigint").alias("bin")
    )
    cut = write_shared(cut, "cut")
    for level in (1, 2, 3):
        fine = F.floor(F.col("place") * float(_BINS**level))
        bins = (
            _with_source(rated.where("place IS NOT NULL").select("rank", "doc_id", "size", "nth", fine.alias("fine")), cut, few)
            .where(F.floor(F.col("fine") / _BINS) == F.col("bin"))
            .groupBy("rank", "missing", "fine")
            .agg(F.sum("size").alias("words"))
        )
        running = F.sum("words").over(W.partitionBy("rank").orderBy("fine"))
        # the last bin that starts before the missing words are reached, and what is missing then
        reached = (
            bins.withColumn("until", running - F.col("words"))
            .where((F.col("until") < F.col("missing")) | (F.col("until") == 0))
            .groupBy("rank")
            .agg(F.max(F.struct("fine", "until", "words")).alias("last"))
        )
        cut = write_shared(
            cut.join(reached, "rank", "left").select(
                "rank",
                (F.col("missing") - F.coalesce("last.until", F.lit(0))).alias("missing"),
                F.coalesce("last.fine", F.col("bin") * _BINS).alias("bin"),
            ),
            "cut",
        )
    cut = cut.select("rank", "missing", (F.col("bin") - 1).alias("bin"))
    added = F.coalesce((F.floor(F.col("place") * float(_BINS**3)) <= F.col("bin")).cast("bigint"), F.lit(0))
    chosen = write_shared(_with_source(rated, cut, few).withColumn("copies", F.col("whole") + added), "chosen")

    # one more copy of the document whose size is nearest to what is still missing
    gap = F.abs(F.col("size") - F.col("missing"))
    nearest = (
        chosen.where((F.col("copies") < most) & (F.col("size") > 0) & (gap < F.col("missing")))
        .groupBy("rank")
        .agg(F.min(F.struct(gap.alias("gap"), _hash().alias("hash"), "size")).alias("best"))
        .select("rank", F.col("best.hash").alias("best_hash"), F.col("best.size").alias("best_size"), F.lit(1).alias("more"))
    )
    nearest = sources.select("rank").join(nearest, "rank", "left")
    filled = _with_source(chosen, write_shared(nearest, "nearest"), few)
    is_best = (_hash() == F.col("best_hash")) & (F.col("size") == F.col("best_size")) & (F.col("copies") < most)
    copies = F.col("copies") + F.when(is_best, F.lit(1)).otherwise(0)
    return filled.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate"
    )
