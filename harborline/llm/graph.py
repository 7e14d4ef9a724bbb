"""Connected components of an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Alternates large-star and small-star steps; each takes a minimum per node (combined before the
    shuffle, so a hub costs one row per task) and a join of edges to those minima, which adaptive
    execution splits where a hub is skewed. The rows never outgrow the edges. Each round is a written
    table, so a lost executor repeats one round at most. An empty edge table gives an empty result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen, turn = scratch.save(now, "edges-0"), None, 0
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen, turn = mark, turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = scratch.save(small.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
