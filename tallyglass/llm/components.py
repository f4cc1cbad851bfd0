"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.plans.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    # edges hold a < b: b's smaller neighbours and b itself move to the smallest of them
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    return moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))


def _mark(edges: DataFrame) -> tuple:
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(mark)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the component's smallest node.

    Each round is written to the shared folder. A hub's neighbours meet only in a minimum, which is
    aggregated before the shuffle, and in a join that adaptive execution splits; nothing is collected.
    """
    ordered = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stage(ordered.distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = stage(_small_star(_large_star(edges).distinct()).filter("a <> b").distinct(), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
