"""Connected components of a large, possibly star-shaped graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.sources.scratch import durable


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b); root is the smallest node.

    Large-star and small-star steps in turn: each node's neighbours are re-linked to its smallest
    neighbour until every component is a star. Each step is a grouped minimum, combined before the
    shuffle, and a join; a hub's edges are never gathered in one place. Every round is written to
    shared storage, which cuts the lineage. Self-links are ignored; no edges give no rows.
    """
    edges = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = (
            both.join(low, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low).distinct()
        )
        edges = durable(small.toDF("a", "b"))
        if (now := _mark(edges)) == mark:
            break
        mark = now
    star = edges.toDF("node", "root")
    return star.union(star.select(F.col("root").alias("node"), "root").distinct())
