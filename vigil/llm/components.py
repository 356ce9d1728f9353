"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.session import drop, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; long), component being the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the edges stay the same: every step
    hangs nodes below smaller neighbours, so the depth shrinks by half and more, and the edges never grow.
    Each round's edges are written to the shared folder. Minima are taken by partial aggregates, and the joins
    back to a hub's many edges are ones that adaptive execution can split. Nulls and loops are dropped; no edges
    give no rows. The result is a stored table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = stored(e, "edges")
    signature = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    before = e.select(signature.alias("x")).first()["x"]
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least).distinct()
        after = stored(small, "edges")
        now = after.select(signature.alias("x")).first()["x"]
        drop(e)
        e = after
        if now == before:
            break
        before = now
    out = stored(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop(e)
    return out
