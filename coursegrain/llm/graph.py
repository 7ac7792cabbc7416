"""Connected components by contraction, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, root of each node in links (a, b): root is the same within a component.

    Each round gives every node the least name among its own and its neighbours', and keeps
    the links between different names. With names that are hashes, as callers use, a long
    chain shrinks by a constant share each round. A hub costs one row for each of its links,
    sums before the shuffle, and is spread over tasks where links meet their new names. Each
    round is written to the shared folder."""
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new"))
        least = written(least, "least")
        if names is None:
            names = least.select(F.col("old").alias("node"), F.col("new").alias("root"))
        else:
            names = salted_join(names, least.withColumnRenamed("old", "root"), ["root"], ["node"], "left").select("node", F.coalesce("new", "root").alias("root"))
            names = written(names, "names")
        left = written(salted_join(edges, least.withColumnsRenamed({"old": "a", "new": "na"}), ["a"], ["b"]), "links-one")
        right = salted_join(left, least.withColumnsRenamed({"old": "b", "new": "nb"}), ["b"], ["a"])
        edges = written(right.filter("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "links")
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
