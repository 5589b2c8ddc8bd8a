"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn pull nodes to smaller neighbours until nothing changes, in about the square
    of the diameter's logarithm of rounds. Edges are kept once, from the larger node (u) to the smaller (v); a node without a smaller
    neighbour, as the root of a finished star is, has no row in what others are joined with, so that this shrinks to what still moves and is broadcast in the
    end; before, Spark splits the rows of a hub. Each round's edges are written to the shared folder, so lineage stays short
    and lost executors cost one round at most. Loops, repeated edges and edges with a null end are left out.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct())
    seen = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (now["n"], now["s"]) or not now["n"]:
            break
        seen = now["n"], now["s"]
        least = e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = e.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        e = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
