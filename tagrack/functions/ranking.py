"""Ordering helpers that never pull a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, partition_cols: Sequence[str], order: Sequence[Column],
          k: Column | int, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group, numbered 1..k in ``rank_col``.

    A literal ``k`` lets Catalyst plan a partial ``WindowGroupLimit`` below the
    shuffle, so a hot group sends at most k rows per map task. A per-row ``k``
    (a column) is applied after the window.
    """
    w = Window.partitionBy(*partition_cols).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    if isinstance(k, int):
        return out.filter(F.col(rank_col) <= F.lit(k))
    return out.filter(F.col(rank_col) <= k)


def positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
              pos_col: str = "position") -> DataFrame:
    """1-based position of each row in its group, ordered by ``order_cols``.

    A group may hold a third of all rows, so no window may span a group.
    Instead: one range-partitioned sort on (group, order) -- Spark samples the
    keys, so a hot group is split over many tasks -- written once (checkpoint)
    so every branch sees the same partitions; then per (partition, group) a row
    count and the first row id (a small table: at most groups + partitions
    rows), running totals of the counts give each slice's offset, and a row's
    position is offset + its index inside the slice.
    """
    from ..plans.materialize import materialize

    keys = [F.col(c).asc_nulls_first() for c in group_cols] + \
        [F.col(c).asc_nulls_last() for c in order_cols]
    ordered = materialize(df.orderBy(*keys)
                          .withColumn("_pos_pid", F.spark_partition_id())
                          .withColumn("_pos_rid", F.monotonically_increasing_id()))
    slices = (ordered.groupBy("_pos_pid", *group_cols)
              .agg(F.count(F.lit(1)).alias("_pos_n"), F.min("_pos_rid").alias("_pos_first")))
    w = (Window.partitionBy(*group_cols).orderBy("_pos_pid")
         .rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.withColumn("_pos_off", F.coalesce(F.sum("_pos_n").over(w), F.lit(0))).drop("_pos_n")
    keys = ["_pos_pid"] + list(group_cols)
    slices = slices.select(*[F.col(k).alias(f"_pos_s{i}") for i, k in enumerate(keys)], "_pos_first", "_pos_off")
    cond = [F.col(k).eqNullSafe(F.col(f"_pos_s{i}")) for i, k in enumerate(keys)]
    return (ordered.join(slices, cond)
            .withColumn(pos_col, (F.col("_pos_off") + F.col("_pos_rid") - F.col("_pos_first") + 1).cast("long"))
            .select(*df.columns, pos_col))
