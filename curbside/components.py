"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbside.runtime import cut
from curbside.skew import spread_join


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex of ``edges(u, v)``; component is the least vertex reachable.

    Alternating star contraction: each vertex hands its larger neighbours, then
    its smaller ones, to the least it knows, until nothing changes. The number
    of rounds grows with the logarithm of the graph; the neighbours of a vertex
    of very many are dealt to several places, and each round is cut off from
    those before it.
    Loops and repeated edges are allowed; null ends are dropped.
    """
    pairs = cut(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL"), "edges")
    vertices = pairs.select("u").union(pairs.select("v")).distinct()
    state, mark, n = pairs.filter("u <> v"), None, pairs.count()
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = spread_join(both.filter("v > u"), least, "u", "k", "v", total=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Edges run from the larger to the smaller end from here on.
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = spread_join(large, down, "u", "k", "v", total=n).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        state = cut(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct(), "edges")
        found = state.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (found.n, found.h) == mark:
            break
        mark, n = (found.n, found.h), found.n
    best = state.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.join(best, "u", "left").select(F.col("u").alias("v"), F.coalesce("component", "u").alias("component"))
