"""Connected components by alternating large-star and small-star steps; nothing but their changes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the least node reachable, for every node but the least of each component.

    Each round is two aggregates and two joins on the node; a hub's rows can be split by the join, as its minimum is one row.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    sign = None
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("low"))
        large = both.join(low, "u").where("w > u").select(F.col("w").alias("v"), F.least("u", "low").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.when(F.col("m") != F.col("low"), F.col("m")).alias("v"), F.col("low").alias("m")), F.struct(F.col("v").alias("v"), F.col("low").alias("m")))).alias("e")).select("e.v", "e.m").where("v is not null").distinct()
        after = written(small, "edges")
        dropped(now)
        now = after
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")).first()
        if (new["n"], new["h"]) == sign:
            return now.select(F.col("v").alias("node"), F.col("m").alias("component"))
        sign = (new["n"], new["h"])
