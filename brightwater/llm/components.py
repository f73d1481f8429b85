"""Connected components by Spark joins, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.common import write_shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns `node` and `root`: the smallest node that each linked node can reach.

    `links` has two bigint columns. Every node takes the smallest root among
    itself and its neighbours, then that root's own root, until none changes;
    the number of rounds grows with the logarithm of the longest path. Links
    are summed up by a minimum before each shuffle. Rows with a null are left
    out, loops and repeated links change nothing.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where(
        "node IS NOT NULL AND other IS NOT NULL"
    )
    both = both.union(both.select("other", "node"))
    both = write_shared(both.distinct(), "links")
    state = write_shared(
        both.groupBy("node").agg(F.min("other").alias("root")).select(
            "node", F.least("node", "root").alias("root")
        ),
        "roots",
    )
    while True:
        offered = (
            both.join(state.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("root").alias("offer"))
        )
        nearer = state.join(offered, "node").select("node", F.least("root", "offer").alias("root"), F.col("root").alias("before"))
        # a root that is itself below another one leads on to it
        lead = state.where("node != root").select(F.col("node").alias("root"), F.col("root").alias("onward"))
        nearer = nearer.join(lead, "root", "left").select(
            "node", F.coalesce(F.least("root", "onward"), "root").alias("root"), "before"
        )
        nearer = write_shared(nearer, "roots")
        changed = not nearer.where("root != before").isEmpty()
        state = nearer.select("node", "root")
        if not changed:
            return state
