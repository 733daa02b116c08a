"""Connected components by alternating large-star and small-star steps.

Every step is a map-side combined ``min`` per node and an equi-join of the edges
with it; a hub's edges are the side that adaptive execution splits.  The number
of edges never grows.  Every second round is checkpointed to the shared folder,
so lineage stays short and a lost executor costs two rounds.  The driver sees a
count and a hash sum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.session import ensure_checkpoint_dir


def _signature(e: DataFrame):
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u < v)."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = both.filter("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).filter("u < v").distinct()
    low = large.groupBy("v").agg(F.min("u").alias("m"))
    small = large.join(low, "v").filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return small.unionByName(low.select(F.col("m").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node on an edge; root is the component's least node.

    Self-loops and repeated edges are allowed, null ends are ignored; an empty
    table gives an empty result."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    e = e.filter("u < v").distinct().checkpoint()
    before = _signature(e)
    while before[0]:
        # two rounds for each checkpoint: half the files, and still a short lineage
        e = _round(_round(e)).checkpoint()
        now = _signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
