"""Connected components of a link table, by star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.llm.store import save


def _stars(near: DataFrame) -> DataFrame:
    """Each node's least neighbour joined back to its neighbours (a hot node's rows can be split)."""
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    return near.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links(u, v)``; a component is named by its least node.

    Alternates large-star and small-star steps; every step only re-points
    links at smaller nodes, so the row count never grows. Ends when a round
    changes nothing. Each round is written to the shared folder. Repeated and
    self links are allowed; an empty table gives an empty one.
    """
    edges = save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u point at u's least neighbour (or u)
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: u and its smaller neighbours point at the least of them
        near = large.where("u > v")
        star = _stars(near)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(star.select("u", F.col("m").alias("v"))).distinct()
        edges = save(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("u") % 1000003), F.sum(F.col("v") % 1000003), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
