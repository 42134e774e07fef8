"""Streaming stock ledger -- the event fold over an unbounded stream.

Each micro-batch is folded by the batch operators: events are validated, the
valid ones folded by ``fold_stock_events`` on top of the stock that the SKUs
had before the batch. That fold cuts the events of crowded SKUs into
order-monotone buckets, so a SKU with a third of the events is spread over
tasks as in a batch; the others stay where the check has put them, by SKU.

The stock per SKU is the state, kept beside the ledger as Parquet under the
output folder: every batch writes the closing stock of the SKUs it touched,
every ``SNAPSHOT_EVERY``-th batch the stock of all SKUs so far. Both are
divided by a hash of the SKU, and a batch reads only the divisions it
touches, of the last snapshot and the few batches since. Each output lies in
its own ``batch=<id>`` folder (overwrite); a mark under ``done`` follows when
all of them are written, and names the snapshot that later batches start from.
A batch that is retried after a failure reads marks of earlier batches only
and rewrites its own folders, so nothing is lost or counted twice. Any columns
of the events pass through.

Arrival order counts between micro-batches, ``order`` inside one. Null SKUs
are unknown SKUs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stock import fold_stock_events, validate_stock_events
from ..sources.tables import read_parquet_if_present

DIVISIONS = 64
SNAPSHOT_EVERY = 16
NO_BATCH = -1


def _division() -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(DIVISIONS)).cast("int")


def _done(spark: SparkSession, out: str, before: int) -> tuple[int, int]:
    """(last whole batch, its snapshot) before batch ``before``."""
    marks = read_parquet_if_present(spark, os.path.join(out, "done"))
    if marks is None:
        return NO_BATCH, NO_BATCH
    last = marks.filter(F.col("batch") < before).agg(F.max(F.struct("batch", "snapshot")).alias("m")).first()["m"]
    return (last["batch"], last["snapshot"]) if last else (NO_BATCH, NO_BATCH)


def read_levels(spark: SparkSession, out: str, before: int, divisions: list[int] | None = None) -> DataFrame | None:
    """(item_id, stock_quantity) of all SKUs seen in whole batches before batch
    ``before``; of the given divisions only, where named. None if nothing is there."""
    last, snapshot = _done(spark, out, before)
    if last == NO_BATCH:
        return None
    closing = spark.read.parquet(os.path.join(out, "closing")).filter((F.col("batch") > snapshot) & (F.col("batch") <= last))
    if snapshot != NO_BATCH:
        closing = closing.unionByName(spark.read.parquet(os.path.join(out, "snapshot")).filter(F.col("batch") == snapshot))
    if divisions is not None:
        closing = closing.filter(F.col("division").isin(divisions))  # folders of others are not listed into the scan
    return closing.groupBy("item_id").agg(F.max_by("stock_quantity", "batch").alias("stock_quantity"))


def fold_batches(sku: DataFrame, order: Sequence[str], out: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: valid events with their deltas -> ledger/, the rest
    with their status -> rejects/, closing stocks -> closing/ and snapshot/."""
    def folder(name: str, batch_id: int) -> str:
        return os.path.join(out, name, f"batch={batch_id}")

    def by_division(levels: DataFrame, path: str) -> None:
        # a division is written by one task: 64 files of a batch, not 64 from every task
        levels.withColumn("division", _division()).repartition(DIVISIONS, "division").write.mode("overwrite").partitionBy("division").parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = validate_stock_events(batch, sku).persist()
        valid = checked.filter(F.col("status") == "ok").drop("status")
        touched = sorted(r[0] for r in valid.select(_division().alias("d")).distinct().collect())  # at most DIVISIONS numbers
        opening = read_levels(spark, out, batch_id, touched)
        fold_stock_events(valid, order, opening=opening).write.mode("overwrite").parquet(folder("ledger", batch_id))
        checked.filter(F.col("status") != "ok").write.mode("overwrite").parquet(folder("rejects", batch_id))
        checked.unpersist()

        deltas = spark.read.parquet(folder("ledger", batch_id)).groupBy("item_id").agg(F.sum("delta_quantity").alias("change"))
        if opening is not None:
            deltas = deltas.join(opening, "item_id", "left")
        else:
            deltas = deltas.withColumn("stock_quantity", F.lit(0).cast("long"))
        by_division(deltas.select("item_id", (F.coalesce("stock_quantity", F.lit(0)) + F.col("change")).cast("long").alias("stock_quantity")),
                    folder("closing", batch_id))
        last, snapshot = _done(spark, out, batch_id)
        mark = spark.range(1).select(F.lit(snapshot).cast("long").alias("snapshot"))
        if batch_id - max(snapshot, 0) >= SNAPSHOT_EVERY:
            now = spark.read.parquet(folder("closing", batch_id)).withColumn("batch", F.lit(batch_id).cast("long"))
            before = read_levels(spark, out, batch_id)
            both = now.select("item_id", "stock_quantity", "batch")
            if before is not None:
                both = both.unionByName(before.withColumn("batch", F.lit(NO_BATCH).cast("long")))
            by_division(both.groupBy("item_id").agg(F.max_by("stock_quantity", "batch").alias("stock_quantity")), folder("snapshot", batch_id))
            mark = spark.range(1).select(F.lit(batch_id).cast("long").alias("snapshot"))
        mark.write.mode("overwrite").parquet(folder("done", batch_id))  # last: the batch is whole
    return write


def read_ledger(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, rejects) of all whole batches."""
    last, _snapshot = _done(spark, out, 1 << 62)
    ledger, rejects = (spark.read.parquet(os.path.join(out, name)).filter(F.col("batch") <= last).drop("batch")
                       for name in ("ledger", "rejects"))
    return ledger, rejects
