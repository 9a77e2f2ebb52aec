"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Returns node and root, the smallest node reachable, for every node of ``edges`` (a, b: long).

    Every step gives each node the smallest root among its neighbours and then the root of its root, so the
    steps grow with the logarithm of the longest chain in practice. Each step's table is written, so lost executors
    replay one step. Loops and repeated edges do no harm; no edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a != b").distinct(), "graph-edges")
    roots = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "graph-roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("low")
        )
        above = roots.select(F.col("node").alias("low"), F.col("root").alias("above"))
        fresh = materialize(
            lower.join(above, "low", "left").select("node", "old", F.least("low", F.coalesce("above", "low")).alias("root")), "graph-step"
        )
        settled = fresh.where("root != old").isEmpty()
        roots = fresh.select("node", "root")
        if settled:
            return roots
