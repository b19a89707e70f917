"""Connected components of an edge table, and a union-find for what one task already holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import new_path, removed, written


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component among n nodes joined by edges a-b (min-label passes with jumps)."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of edges (u long, v long).

    Alternates large-star and small-star rounds, which keep the edge count linear, until no node that points to a smaller one
    has a second neighbour, that is, until only stars are left. With `rounds`, stops after so many; nodes of equal component
    are then linked, but a component may still have several names. Each round is written to the shared folder and the one
    before it removed; the driver sees one count. Self-links and repeated links are harmless.
    """
    spark = edges.sparkSession
    path = new_path(spark, "links")
    edges = written(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    done = 0
    while not edges.isEmpty() and (rounds is None or done < rounds):
        seen = Observation()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = low.observe(seen, F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("bent")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour goes to the smallest one
        star = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the node itself go to the smallest one
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(low, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, path = path, new_path(spark, "links")
        edges = written(edges.filter("u != v").distinct(), path)
        removed(spark, last)
        done += 1
        if not seen.get["bent"]:
            break
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(edges.select("v", "v").distinct())
