"""Connected components of an edge table, by alternating star contractions.

Each round hangs the neighbours of every node on the smallest of them (large
star), then does the same among smaller neighbours only (small star); rounds
needed grow with the logarithm of the longest path.  Minima are pre-aggregated
before the shuffle and the joins back may be split by AQE, so a node with very
many neighbours is not gathered anywhere.  Every round is written to the
shared checkpoint folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapecode.llm.common import written


def _hang(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs (u, v): link every v (and u) to the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = pairs.join(least, "u")
    if keep_larger:
        out = out.where("v > u")
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return (out.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches, itself included.

    ``edges`` may repeat and be given in either direction or both; self edges are
    ignored, and nodes without an edge are not returned.
    """
    now = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    now = written(now, name)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, keep_larger=True).distinct()
        small = _hang(large, keep_larger=False).distinct()
        now = written(small, name)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
