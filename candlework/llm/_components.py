"""Connected components by contraction, on tables only.

Every round each vertex takes as its root the vertex with the smallest rank among itself and its neighbours, ranks being
a hash that changes each round, and edges are rewritten to roots. A round removes a constant share of the vertices, in
expectation, of a path as of a star, so rounds grow with the logarithm of the largest component. Each round is two
joins on written tables (Spark splits hot keys of such joins) and aggregations that combine inside tasks; nothing is
gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm._store import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(v, root) for each end of an edge (a, b); two vertices have the same root if a path joins them."""
    step = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    maps: list[DataFrame] = []
    while not step.isEmpty():
        k = len(maps)
        rank = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("rank"), F.col(c).alias("v"))
        both = step.select("a", "b").unionAll(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(k), "b").alias("rank"), F.col("b").alias("v"))).alias("least"))
        root = scratch.keep(least.select(F.col("a").alias("v"), F.least(F.col("least"), rank("a"))["v"].alias("root")), f"{name}-roots-{k}")
        maps.append(root)
        left = step.join(root.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a")
        both = left.join(root.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        step = scratch.keep(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges-{k + 1}")
        scratch.drop(f"{name}-edges-{k}")
    if not maps:
        return step.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("v").alias("root"), F.col("root").alias("next"))
        out = out.join(later, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    return scratch.keep(out, f"{name}-roots")
