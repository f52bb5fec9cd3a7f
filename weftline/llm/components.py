"""Connected components of a link table by alternating large-star and small-star steps, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import removed, written


def components(links: DataFrame, *, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that links reach. Nulls are left out.

    RuntimeError where rounds run out before the links settle: components are whole or there are none. Joins are by sort
    and merge, so that the driver holds nothing that grows with the links.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges, seen = written(edges, "links"), None
    for _ in range(rounds):
        # large star: every larger neighbour of u is linked with the least of u's neighbourhood
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours are linked with the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least.hint("merge"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, edges = edges, written(small.unionByName(least.select("hi", F.col("m").alias("lo"))).where("lo <> hi").distinct(), "links")
        removed(last)
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    found = edges.groupBy("hi").agg(F.min("lo").alias("component"))
    return found.select(F.col("hi").alias("id"), "component").unionByName(found.select(F.col("component").alias("id"), "component").distinct())
