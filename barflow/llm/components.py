"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import cut


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of `edges` (a, b).

    Alternating large-star and small-star steps: each node hangs its larger neighbours, then its smaller ones, onto its
    smallest neighbour. Every step is a minimum by key (combined before the shuffle) and a join, and the written edges never
    outnumber the input's. Null ends and loops are left out.
    """
    e = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # the node itself hangs on its smallest neighbour too
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select("b", "b").distinct().toDF("node", "component"))
