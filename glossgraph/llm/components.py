"""Connected components of a link table, in Spark jobs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossgraph.llm.common import cut, few, unsized


#: Rows of a key from which on it counts as hot, and hot keys that there may be at most.
HOT_ROWS = 1000
HOT_KEYS = 50_000


def join_one(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Join rows (at most `total`) with the only row that `one` has for each key, n being how many rows a key has.

    Hot keys are those with more rows than their fair share of HOT_KEYS, so they are HOT_KEYS at most: their part
    of `one` is broadcast, and their rows aren't moved. All other keys have few rows each and meet by a shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = one.where(F.col("n") > limit).drop("n"), one.where(F.col("n") <= limit).drop("n")
    of_hot = rows.join(F.broadcast(hot), key)
    of_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return of_cold.unionByName(of_hot)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): each linked node with the smallest node that it reaches.

    Alternates large-star and small-star steps until all links are stars around their smallest node. Each step takes a
    minimum by node, which Spark sums up before its shuffle, and joins it back to the links: links of very many to one
    node are joined where they lie, so no task gathers the neighbours of a node. Null ends, self-links, repeated links
    and empty tables are fine. Each step is checkpointed, in as many partitions as its rows need: many rounds over
    a few links would leave a file for each partition of each shuffle otherwise.
    """
    edges = cut(
        unsized(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    )
    rows = edges.count()
    edges = few(edges, rows)
    while True:
        both = few(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * rows)
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), 2 * rows)
        # in a star, a node with a smaller neighbour has no other one
        if least.where("m < u AND n > 1").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        # each node's larger neighbours, which are the greater ends of its links, point to its smallest neighbour or itself
        large = cut(join_one(edges, least, "u", rows).select(F.col("m").alias("u"), "v"), rows)
        # each node v points to its smallest neighbour; its other smaller neighbours point there, too
        down = cut(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), rows)
        small = join_one(large, down, "v", rows).select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        edges = cut(unsized(few(small.where("u <> v"), 2 * rows).distinct()), 2 * rows)
        rows = edges.count()
