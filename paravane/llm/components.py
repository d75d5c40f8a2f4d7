"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paravane.llm.common import settle


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) with the least neighbour of u, itself included.

    The minimum is aggregated before the shuffle and joined back, so that a
    node with very many neighbours is split like any skewed join key.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected(links: DataFrame) -> DataFrame:
    """Components of (a, b) links: (node, component), component the least node reached.

    Self-links and repeated links are ignored; nodes without a link do not
    appear.  Large stars move each larger neighbour to the least one, small
    stars the smaller neighbours; the rounds needed grow with the logarithm
    of the longest path.  Each round is checkpointed.
    """
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        large = _with_least(_both(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large)
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = settle(small)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
