"""Connected components of a link table, by alternating star contractions.

A large-star step hangs every larger neighbour of a node on the smallest node around it, a small-star step the
smaller ones; both are a minimum per node (summed before the shuffle) and a join. The links become a forest of stars in a
few rounds, whatever the shape of the components, and no node's neighbours are ever gathered into a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _is_forest(links: DataFrame) -> bool:
    """Every node hangs on one other and none that others hang on hangs itself."""
    twice = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = links.select("u").join(links.select(F.col("v").alias("u")), "u", "left_semi")
    return twice.unionByName(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b) that are not the smallest of their component.

    Links may repeat, run either way or join a node to itself; those with a null end are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    while not _is_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
