"""Times for summing facts through a lookup by four ways, on a larger table.

    python scripts/lookup_sum_figures.py SCRATCH [--times 20] [--threads 8] [--data /root/testdata/sf0.1]

The larger table is `lineitem` of the data folder, repeated `--times` times and
written to SCRATCH, a new or empty folder of the caller's. Keys are spread by a
hash over 1,000 up to a third as many suppliers as lines, in the last case with
a third of the lines on one of them. The second of two runs of each case is
printed, as a row of a Markdown table; all ways must agree on the result.

- broadcast: the lookup is sent to all tasks (`limit_bytes` without bound).
- sum, merge: lines are summed by key, then joined (`limit_bytes=0`).
- merge: lines are shuffled and joined as they are.
- heavy split: keys with over a thousandth of a sample of lines are joined with
  their broadcast rows; the other lines are shuffled and joined as they are.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from brightwater.operators.lookup_sum import sum_through_lookup  # noqa: E402
from brightwater.session import local_session  # noqa: E402

NO_BOUND = 1 << 60


def merged(facts, lookup):
    return lookup.hint("merge").join(facts, "k").groupBy("g").agg(F.sum("m").alias("m"))


def heavy_split(facts, lookup):
    sample = facts.sample(0.01, 7)
    n = sample.count()
    heavy = sample.groupBy("k").count().where(F.col("count") > n / 1000).select("k")
    heavy = F.broadcast(heavy.limit(1000))
    few = F.broadcast(lookup.join(heavy, "k", "left_semi"))
    first = facts.join(few, "k").groupBy("g").agg(F.sum("m").alias("m"))
    rest = lookup.hint("merge").join(facts.join(heavy, "k", "left_anti"), "k").groupBy("g").agg(F.sum("m").alias("m"))
    return first.union(rest).groupBy("g").agg(F.sum("m").alias("m"))


WAYS = {
    "broadcast": lambda f, l: sum_through_lookup(f, l, "k", "g", ["m"], NO_BOUND),
    "sum, merge": lambda f, l: sum_through_lookup(f, l, "k", "g", ["m"], 0),
    "merge": merged,
    "heavy split": heavy_split,
}


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("scratch")
    args.add_argument("--times", type=int, default=20)
    args.add_argument("--threads", default="8")
    args.add_argument("--data", default="/root/testdata/sf0.1")
    args = args.parse_args()
    spark = local_session(args.threads)
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{args.data}/lineitem.parquet").select(F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("m"))
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    path = f"{args.scratch}/lines"
    lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(args.times)))).select("m", F.xxhash64("line", "copy").alias("h")).write.parquet(path)
    n = spark.read.parquet(path).count()
    print(f"{n:,} lines, {args.threads} threads, seconds\n\n| Suppliers | {' | '.join(WAYS)} |\n|{' --- |' * (len(WAYS) + 1)}")
    for keys, hot in ((1_000, False), (n // 60, False), (n // 3, False), (n // 3, True)):
        spread = F.pmod("h", F.lit(keys))
        key = F.when(F.pmod(F.col("h") / 7, F.lit(3)).cast("int") == 0, 7).otherwise(spread) if hot else spread
        facts = spark.read.parquet(path).select(key.cast("bigint").alias("k"), "m")
        lookup = spark.range(keys).select(F.col("id").alias("k"), (F.col("id") % 25).cast("int").alias("g"))
        row, results = [], set()
        for way in WAYS.values():
            for _ in range(2):
                began = time.perf_counter()
                rows = way(facts, lookup).collect()
                took = time.perf_counter() - began
            row.append(f"{took:.1f}")
            results.add(tuple(sorted(tuple(r) for r in rows)))
        assert len(results) == 1, "the ways disagree"
        print(f"| {keys:,}{', a third of the lines on one' if hot else ''} | {' | '.join(row)} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
