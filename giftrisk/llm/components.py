"""Connected components of an edge table by alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each step is an aggregate and a join; the edges go through a table in the shared
folder after every round, and the driver sees two numbers per round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import drop_stage, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``, a <> b, to ``(node, root)``, one row per node that has an
    edge; root is the smallest node of its component."""
    now, state = stage(edges.select("a", "b").distinct(), "edges"), None
    while True:
        new = stage(_small_star(_large_star(now).distinct()).distinct(), "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stage(now)
        now = new
        if tuple(seen) == state:
            break
        state = tuple(seen)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())
