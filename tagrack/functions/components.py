"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every vertex of ``edges`` (a, b: long) with the least vertex it reaches.

    A round hangs each vertex's greater neighbours, then its lesser ones, on its
    least neighbour; a logarithmic number of rounds leaves one star per
    component. Minima combine map-side, each round is written, and one
    number a round reaches the driver.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now[0] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        ways = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = ways.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        up = hung.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(up.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
