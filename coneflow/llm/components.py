"""Connected components of a graph given as a table of edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, in_few_tasks, joined, joined_apart, stored


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for every node of the stored ``edges`` (a, b) that isn't the least of its component; root is the least.

    Each round is two group-and-join steps on the edges. Nodes with very many
    edges are few, so what is known about them is broadcast and only the edges of
    all others are shuffled by node. Edges and nodes of each round are written to
    the shared folder, in as many tasks as their number asks for; the driver sees
    a few numbers, and whether any edge is left to change.
    """
    a, b = F.col("a"), F.col("b")
    rows = edges.count()  # no round has more
    now = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = stored(in_few_tasks(now, rows), folder, f"{name}0")
    turn = 0
    while True:
        both = now.withColumn("child", F.lit(1)).unionByName(now.select(b.alias("a"), a.alias("b"), F.lit(0).alias("child")))
        nodes = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"), F.sum("child").alias("lesser"))
        nodes = stored(in_few_tasks(nodes, 2 * rows), folder, f"{name}nodes{turn}")
        # done when every edge leads to a root, and none has two: then each component is one star
        if not nodes.filter("lesser > 1 or (lesser = 1 and n > 1)").take(1):
            return now.select(a.alias("node"), b.alias("root"))
        turn += 1
        large = joined(both.drop("child"), nodes.select("a", "m", "n"), ["a"], "n").filter(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = stored(in_few_tasks(large, 2 * rows), folder, f"{name}large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = in_few_tasks(joined_apart(large, least, hot_keys(nodes, ["a"], "lesser"), ["a"]), rows)
        # (a, m) of every node, and (b, m) of its other neighbours; what repeats falls away in the last grouping
        small = met.filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(in_few_tasks(least, rows).select("a", F.col("m").alias("b"))).distinct()
        now = stored(in_few_tasks(small, rows), folder, f"{name}{turn}")
