"""Connected components of a graph given as a table of edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of an edge (a, b of one orderable type), the smallest node that it reaches.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. Edges never grow in number, a long path shrinks by a factor each round, and a node with many
    neighbours only ever sends one row for each. Each round is written to the shared folder. Loops (a = b) are isolated
    nodes. An empty table gives no rows."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pairs = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while open_pairs := _open(pairs):
        pairs = pairs.coalesce(1 + open_pairs // PAIRS)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        pairs = checkpointed(small.distinct())
    return nodes.join(pairs.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))


#: Pairs that a task reads at least, so that a small graph doesn't take a task for each partition that it was left in.
PAIRS = 100_000


def _open(pairs: DataFrame) -> int:
    """The number of pairs, or 0 if they are stars: every node has one smaller node at most, which has none."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
    ends = ends.unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    ends = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.sum("larger").alias("larger"))
    n, chained = ends.agg(F.sum("smaller"), F.count_if((F.col("smaller") > 1) | ((F.col("smaller") > 0) & (F.col("larger") > 0)))).first()
    return n if chained else 0
