"""Graph operators: connected components, clusters, mesh components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.sources.tables import stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of undirected edges ``a, b`` (long).

    Nodes of loops only are their own component.  Each round links every node's larger
    neighbours to its smallest one, then its smaller neighbours; the rounds grow with the
    logarithm of the longest chain.  Rounds are written to the shared folder.
    """

    def state(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        moved = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.union(star.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
