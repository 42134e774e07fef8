"""Debounced search log -- the last query of each typing burst per user.

A burst continues while the gap to the user's previous query is at most
``gap`` (150 ms in the search box). Built on ``session_window``; the batch
twin runs the same aggregation on a static DataFrame. Event time must be a
TIMESTAMP for watermarks, so NTZ input is cast in and the window is cast back.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..sources.tables import read_parquet_if_present

DEFAULT_GAP = "150 milliseconds"


def debounce(log: DataFrame, gap: str = DEFAULT_GAP, watermark: str | None = None) -> DataFrame:
    """(user_id, window_start, window_end, last_query, n_queries) per burst.

    ``log`` has (user_id, ts, query) and may have event_id, which settles ties. With ``watermark`` set (streams),
    late rows older than the watermark are dropped and bursts are emitted once
    the watermark passes their end.
    """
    x = log.withColumn("_ts", F.col("ts").cast("timestamp"))
    if watermark:
        x = x.withWatermark("_ts", watermark)
    # queries of one instant: the later event id, or failing ids the greater text
    tie = ["event_id"] if "event_id" in log.columns else ["query"]
    agg = x.groupBy("user_id", F.session_window("_ts", gap).alias("w")).agg(
        F.max_by("query", F.struct("_ts", *tie)).alias("last_query"),
        F.count(F.lit(1)).alias("n_queries"))
    return agg.select("user_id",
                      F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      "last_query", "n_queries")


# ---- the same with late rows kept ---------------------------------------------

def merge_bursts(rows: DataFrame, gap: str) -> DataFrame:
    """Bursts (user_id, first, last, last_query, last_id, n) from rows of the same
    shape, a query being a burst of one: those at most ``gap`` apart are one."""
    w = Window.partitionBy("user_id").orderBy("first", "last", "last_id")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("first") > reach + F.expr(f"INTERVAL {gap}"))).cast("int")
    x = rows.withColumn("_new", fresh)
    x = x.withColumn("_burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy("user_id", "_burst").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.max_by("last_query", F.struct("last", "last_id", "last_query")).alias("last_query"),
        F.max_by("last_id", F.struct("last", "last_id", "last_query")).alias("last_id"), F.sum("n").alias("n")).drop("_burst")


def debounce_batches(out: str, gap: str, delay: str):
    """foreachBatch writer of a debounced log that loses no row.

    The watermark of a batch is the latest time of all earlier batches less
    ``delay``. Rows behind it go to ``late/`` as they came; the others join the
    open bursts of the last batch. Bursts that no row on time can reach any more go to
    ``bursts/``, the rest stay open under ``open/``. Each batch has its own
    folders (overwrite) and its mark, with the latest time, under ``done/`` at
    the end, so a batch that comes again rewrites what it wrote. A null time is late.
    """
    def folder(name: str, batch_id: int) -> str:
        return os.path.join(out, name, f"batch={batch_id}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = read_parquet_if_present(spark, os.path.join(out, "done"))
        last = marks.filter(F.col("batch") < batch_id).agg(F.max(F.struct("batch", "latest")).alias("m")).first()["m"] if marks is not None else None
        ident = F.col("event_id") if "event_id" in batch.columns else F.lit(None).cast("long")
        rows = batch.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "query", ident.alias("event_id")).persist()
        latest = rows.agg(F.max("ts")).first()[0]
        before = last["latest"] if last else None
        latest = max([x for x in (latest, before) if x is not None], default=None)
        mark = lambda t: F.lit(t).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        late = F.col("ts").isNull() | (F.col("ts") < mark(before) if before is not None else F.lit(False))
        rows.filter(late).write.mode("overwrite").parquet(folder("late", batch_id))
        fresh = rows.filter(~late).select("user_id", F.col("ts").alias("first"), F.col("ts").alias("last"), F.col("query").alias("last_query"),
                                          F.col("event_id").alias("last_id"), F.lit(1).cast("long").alias("n"))
        if last:
            fresh = fresh.unionByName(spark.read.parquet(folder("open", last["batch"])))
        bursts = materialize(merge_bursts(fresh, gap))
        rows.unpersist()
        # a row on time may still come at the new watermark itself
        closed = (F.col("last") + F.expr(f"INTERVAL {gap}") < mark(latest)) if latest is not None else F.lit(False)
        bursts.filter(closed).write.mode("overwrite").parquet(folder("bursts", batch_id))
        bursts.filter(~closed).write.mode("overwrite").parquet(folder("open", batch_id))
        spark.range(1).select(F.lit(latest).cast("timestamp_ntz").alias("latest")).write.mode("overwrite").parquet(folder("done", batch_id))
    return write


def read_bursts(spark: SparkSession, out: str, gap: str) -> tuple[DataFrame, DataFrame]:
    """(bursts as ``debounce`` gives them, the still open ones included; late rows)."""
    last = spark.read.parquet(os.path.join(out, "done")).agg(F.max("batch")).first()[0]
    whole = lambda name: spark.read.parquet(os.path.join(out, name)).filter(F.col("batch") <= last).drop("batch")
    still = spark.read.parquet(os.path.join(out, "open", f"batch={last}"))
    bursts = whole("bursts").unionByName(still).select(
        "user_id", F.col("first").alias("window_start"), (F.col("last") + F.expr(f"INTERVAL {gap}")).alias("window_end"),
        "last_query", F.col("n").alias("n_queries"))
    return bursts, whole("late")
