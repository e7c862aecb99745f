"""Connected components by alternating large-star and small-star contraction, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    edges: two long columns u, v; loops, repeats and either direction are allowed, null ends
    are left out. Each round is written to the shared folder and cuts the lineage. The joins
    are plain equi-joins, whose hot keys the adaptive planner splits; the minima are combined
    before they are shuffled. Rounds grow with the logarithm of the number of nodes.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    before = _digest(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))).alias("e"), "m")
        small = small.select(F.col("e.u").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = materialize(small, "small-star")
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
