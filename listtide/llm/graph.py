"""Connected components of links as Spark joins; every round works on a contracted, smaller graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of `links` (a, b: long), root being the same for all nodes that are connected.

    In a round every node points to its least neighbour, pointers are followed twice, and links between different ends remain for the
    next round. Hubs combine before the shuffle; tables of a round are written, so lost executors cost no more than a round."""
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while True:
        if not edges.limit(1).count():
            return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))
        step = written(step, "component_step")
        for _ in range(2):
            up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = written(step.join(up, "root").select("node", F.col("above").alias("root")), "component_step")
        ends = [step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        edges = written(edges.join(ends[0], "a").join(ends[1], "b").where("a_root <> b_root").select(
            F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        if roots is None:
            roots = step
        else:
            above = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = written(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "component_roots")
