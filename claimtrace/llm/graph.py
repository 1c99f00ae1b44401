"""Connected components of a graph held in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import cut, give_back, join_hot

#: A graph of so many edges at most is solved by one task, in some 30 MB; a larger one in rounds until it is that small.
ONE_TASK = 250_000


def _solved(edges: DataFrame) -> DataFrame:
    """Stars of ``edges`` (``a > b``), which are few: each node but the smallest of its component as ``a``, with that one as ``b``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches if x.num_rows]
        if ends:
            nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
            a, b = at.reshape(2, -1)
            root = np.arange(len(nodes))
            while (root[a] != root[b]).any():
                # roots are tied to smaller ones that their trees have edges to, then all nodes to their root
                x, y = root[a], root[b]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root != root[root]).any():
                    root = root[root]
            tied = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], ["a", "b"])
        give_back()

    return edges.coalesce(1).mapInArrow(solve, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges`` (``a, b`` of longs): the smallest node that it is connected with.

    Alternates two steps until every tree is a star: each node's larger neighbours are tied to its least neighbour, then
    its smaller ones and itself are. Edges never get more, and rounds grow with the logarithm of a path's length. ONE_TASK
    edges or fewer are solved at once, since a round over few edges still costs dozens of stages.
    Edges are in the shared folder after each round, so losing executors costs one round at most. Hubs are joined apart.
    """

    def state(e: DataFrame) -> tuple:
        """The number of edges, and of nodes that keep them from being stars: tied twice, or tied and tied to."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        of = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
        return tuple(of.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if(F.expr("ups > 1 or (ups = 1 and n > 1)"))).first())

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))

    # a is the larger end from here on
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, left = state(now)
    while left:
        if n <= ONE_TASK:
            now = cut(_solved(now))
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(join_hot(both, cut(least(both)), "a", "n", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(least(large))
        small = join_hot(large, low, "a", "n", n).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        n, left = state(now)
    roots = now.select("b").distinct().select(F.col("b").alias("a"), "b")
    return now.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))
