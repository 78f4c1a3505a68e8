"""Connected components of an undirected graph in few distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vestigo.session import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach, for every node with an edge.

    Each round joins every node to the neighbour whose hash is smallest (or keeps it when its own is)
    and contracts the graph; hashes change from round to round, so long chains shrink by a share and
    hubs, which partial sums absorb, vanish at once. Every round is written to the shared folder.
    """
    rest = stash(edges.where("a <> b").select("a", "b").distinct(), "graph")
    found = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    found = stash(found, "graph-roots")
    turn = 0
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.xxhash64("b", F.lit(turn))
        least = both.groupBy("a").agg(F.min(order).alias("h"))
        near = both.withColumn("h", order).join(least, ["a", "h"]).groupBy("a").agg(F.min("b").alias("near"), F.first("h").alias("h"))
        own = F.xxhash64("a", F.lit(turn))
        step = stash(near.select(F.col("a").alias("from"), F.when(F.col("h") < own, F.col("near")).otherwise(F.col("a")).alias("to")), "graph-step")
        found = found.join(step, found["root"] == step["from"], "left")
        found = stash(found.select("node", F.coalesce("to", "root").alias("root")), "graph-roots")
        left = rest.join(step.select(F.col("from").alias("a"), F.col("to").alias("x")), "a")
        left = left.join(step.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        left = left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        rest = stash(left, "graph")
        turn += 1
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(smallest, "root").select("node", "component")
