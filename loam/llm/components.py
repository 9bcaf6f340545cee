"""Connected components by alternating large and small stars.

Edges stay distributed; every round is joins and partial aggregations, written to the shared folder. A node with very
many neighbours is only ever aggregated (minimum, before the shuffle) and joined (which Spark splits where skewed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.llm.common import drop_staged, leaving, stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def component_labels(edges: DataFrame) -> DataFrame:
    """edges (u, v), longs -> (node, label): for every node that is not its component's smallest, that smallest node."""
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        new = stage(small, "edges")
        drop_staged(large)
        drop_staged(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return leaving(now.select(F.col("u").alias("node"), F.col("v").alias("label")), now)
