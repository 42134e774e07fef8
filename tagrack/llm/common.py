"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import written

__all__ = ["written", "small_batches", "table", "text_or_empty", "crc_mod", "broadcast_if", "bounded_share"]

# Most rows a broadcast side of a few numbers may have; about 100 MB in memory.
BROADCAST_ROWS = 2_000_000
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with at most ``ARROW_ROWS`` rows in one Arrow batch of the session:
    whole texts are long, and a batch is what a Python task holds at once."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the folds the contracts fix.

    A null id belongs to no fold; it counts as remainder -1.
    """
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(-1)).cast("int")


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when its counted rows are under the bound;
    beyond it the join shuffles both sides, with the same result."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bounded_share(df: DataFrame, id_col: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of ``df``, chosen by a hash of the id; all if fewer.

    Only for fitting a classifier on labelled rows, where the bound is a
    documented parameter of the operator.
    """
    n = df.count()
    if n <= most:
        return df
    grid = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(grid)) < int(grid * most / n))
