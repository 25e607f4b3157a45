"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.store import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` (bigint ids, either direction, repeats allowed) -> ``(id, component)`` for each id that has an edge.

    ``component`` is the smallest id that can be reached. Each round hangs every node and its larger neighbours on
    the smallest neighbour; the number of rounds grows with the logarithm of the longest path. Loops and null ends
    are ignored; no edges give an empty table. The minima are written before they are joined back, so that adaptive
    execution can split a node with very many edges.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u > v")
    e = cut(e.distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u > v").distinct(), "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
