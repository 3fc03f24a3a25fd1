"""Connected components of an undirected graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component: the smallest id that can be reached.

    Each round sends every neighbour of an id to the smallest one, first those above the id, then those below; the
    rounds end when the links are stars. A hub is handled by a partial minimum and a join whose large side can be
    split, never by gathering its neighbours.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()  # a is the smaller end
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(low, "u").select(F.col("low").alias("a"), "v").union(low.select(F.col("low").alias("a"), F.col("u").alias("v")))
        edges = written(small.where("a <> v").select("a", F.col("v").alias("b")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    ends = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return ends.union(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct().join(ends.select("id"), "id", "left_anti"))
