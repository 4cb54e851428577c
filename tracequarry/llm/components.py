"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over edges (hi, lo) with hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # repeats do no harm here, as there are no more rows than edges, and go at the end
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    hung = large.join(low, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return hung.union(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Labels the nodes of a graph.

    edges: columns a and b (long), any order and with repeats; loops and nulls are ignored.
    Returns node and component (the least node that it reaches), one row per node that has an edge to another node.
    Each round is written to the shared folder, so its plan stays short and a lost executor costs one round at most.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    seen = None
    while True:
        edges = saved(edges, name)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, edges = mark, _stars(edges)
    own = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(own)
