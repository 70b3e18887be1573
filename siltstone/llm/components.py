"""Connected components of a graph that only ever exists as distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


#: A graph of so few links (16 bytes each) is solved without a shuffle, by one task over its written table.
FEW_LINKS = 500_000


def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """edges (a, b long) to (id, component): the smallest id reachable, for every id in an edge.

    Each round hooks every root to the smallest neighbouring root and then shortens the paths; every aggregate is a
    minimum, combined before its shuffle, and each round's table is written, so a lost executor costs one round at most.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "cc-edges")
    small = both.limit(few + 1).count() <= few
    near_by = lambda df: df.coalesce(1) if small else df
    both = near_by(both)
    parent = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).withColumnRenamed("a", "id"), "cc-parents")
    while True:
        parent = near_by(parent)
        grand = parent.join(parent.select(F.col("id").alias("p"), F.col("p").alias("g")), "p").select("id", "p", "g")
        near = both.join(grand.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b").groupBy("a").agg(F.min("gb").alias("m"))
        step = grand.join(near.withColumnRenamed("a", "id"), "id", "left")
        hook = step.filter("m IS NOT NULL").groupBy(F.col("p").alias("id")).agg(F.min("m").alias("h"))
        new = materialize(step.join(hook, "id", "left").select("id", F.col("p").alias("old"), F.least("g", F.coalesce("m", "g"), F.coalesce("h", "g")).alias("p")), "cc-parents")
        changed = new.filter("p <> old").limit(1).count()
        drop_scratch(parent)
        parent = new
        if not changed:
            drop_scratch(both)
            return parent.select("id", F.col("p").alias("component"))
