"""Connected components as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, root): each node that has an edge, and the least node of its component.

    Each round every node takes its least neighbour's name, if that is less than its own; edges are renamed, and those
    within one name and repeats go, so that stars and cliques shrink to a point at once. Rounds go on until no edge is left.
    They are stored; nothing but whether edges are left comes to the driver."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        names = stored(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("root")), "names")
        if labels is None:
            labels = names
        else:
            step = names.select(F.col("id").alias("root"), F.col("root").alias("next"))
            labels = stored(labels.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "labels")
        one, two = (names.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        renamed = edges.join(one, "a").join(two, "b").where("ra <> rb")
        edges = stored(renamed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels
