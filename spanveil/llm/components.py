"""Connected components by alternating stars, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is its smallest reachable node.

    Large star: each node's larger neighbours move to its smallest one; small star: its smaller ones do.
    Both keep what is connected and shorten paths, until every node points at its component's smallest.
    A node with very many neighbours is summed with map-side combine; its row is joined to its links,
    which Spark can split.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staged(edges, "links")
    before = None
    for _ in range(most_steps):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # The smallest neighbour of a node also keeps its own link.
        large = large.unionByName(least.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        older, edges = edges, staged(small.filter(F.col("u") != F.col("v")).distinct(), "links")
        discard(older)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    pointing = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = staged(pointing.unionByName(pointing.select(F.col("component").alias("node"), "component")).distinct(), "components")
    discard(edges)
    return out
