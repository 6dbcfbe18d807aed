"""Connected components of an edge table by repeated contraction.

Each round hooks every node to its neighbour of the least priority, if that is
less than its own, and maps the edges to where their ends hook. Even rounds take
the node itself as its priority, which ends stars about their smallest node at
once; odd rounds take a hash of node and round. As those are drawn anew, every
other round takes a constant share of the nodes away in expectation, whatever
the edges (a path in ascending order, too), so rounds grow with the logarithm of
the largest component's size. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, materialise_counted


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint); the label is one node of the component."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left, rows = materialise_counted(ordered.filter("a <> b").distinct())
    labels = left.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    round_no = 0
    while rows:
        priority = lambda c: F.xxhash64(F.col(c), F.lit(round_no)) if round_no % 2 else F.col(c)  # noqa: B023, E731
        rank = lambda c: F.struct(priority(c).alias("p"), F.col(c).alias("node"))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        hooks = materialise(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("least"))["node"].alias("to")))
        if not round_no:
            labels = hooks.select("node", F.col("to").alias("label"))
        else:
            step = hooks.select(F.col("node").alias("label"), "to")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        round_no += 1
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("na"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        moved = left.join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
        left, rows = materialise_counted(moved.filter("a <> b").distinct())
    return materialise(labels)
