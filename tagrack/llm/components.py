"""Connected components of an edge table by alternating star contractions.

Every vertex's edges are replaced by edges to its smallest neighbour: first
larger neighbours move to the smallest (large star), then smaller ones (small
star). The table becomes one star per component in a logarithmic number of
rounds. Each round aggregates with map-side partial minima and is written to
the shared folder, so lineage stays one round deep and nothing but two
numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.where("b > a").join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every vertex of ``edges`` (a, b); component_id is
    the smallest id reachable. Self-loops and nulls are ignored; no edges give
    no rows. The loop ends when a round changes nothing."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"),
                                             F.least("a", "b").cast("long").alias("b")).distinct(), "cc")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        e = written(_small_star(_large_star(e)), "cc")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
