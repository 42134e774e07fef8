"""Run the streams to completion (``availableNow``) over files in the shared
scratch folder and read their sinks back as batch DataFrames.

These drive the streaming operators from the driver's tables for the
registered queries and tests; a production deployment points the same
``readStream`` at its landing folder and keeps the query running.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import written
from ..session import scratch_path
from . import debounce as deb
from . import ingest as ing
from . import ledger as led


def _run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def run_ledger(spark: SparkSession, waves: list[DataFrame], sku: DataFrame,
               order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Land each wave of stock events as new files, run the stream over what
    has landed (state carries from wave to wave); return (ledger, rejects)."""
    root = scratch_path(spark, "ledger")
    src, out, ck = (os.path.join(root, d) for d in ("src", "out", "ck"))
    schema = waves[0].schema
    sku = written(sku.select("item_id").distinct(), "known-skus")  # every batch asks for the ids alone
    for wave in waves:
        wave.write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        _run(stream.writeStream.foreachBatch(led.fold_batches(sku, order, out)).option("checkpointLocation", ck))
    return led.read_ledger(spark, out)


def run_debounce(spark: SparkSession, log: DataFrame | list[DataFrame], gap: str, watermark: str,
                 end_marker_user: int = -1) -> DataFrame:
    """Land the log (one DataFrame, or waves landed and processed one after
    another) and finally one end-of-input marker far in the future, so the
    watermark passes every burst; run the append-mode stream into a Parquet
    sink after each landing; read the bursts back (marker removed). Rows of a
    later wave older than the watermark are dropped, as late data is."""
    root = scratch_path(spark, "debounce")
    src, out, ck = (os.path.join(root, d) for d in ("src", "out", "ck"))
    waves = log if isinstance(log, list) else [log]
    # the event id settles queries of one instant, where the log has one
    cols = [*(["event_id"] if "event_id" in waves[0].columns else []), "user_id", "ts", "query"]
    waves = [w.select(*cols) for w in waves]
    marker = spark.createDataFrame([(end_marker_user, "9999-12-31 00:00:00", "")],
                                   "user_id long, ts string, query string") \
        .withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "event_id": F.lit(-1).cast("long")}).select(*cols)
    for wave in waves + [marker]:
        wave.write.mode("append").parquet(src)
        stream = spark.readStream.schema(waves[0].schema).parquet(src)
        _run(deb.debounce(stream, gap, watermark).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ck).outputMode("append"))
    return spark.read.parquet(out).filter(F.col("user_id") != F.lit(end_marker_user))


def run_debounce_late(spark: SparkSession, waves: list[DataFrame], gap: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """Land the log wave by wave and run the stream that keeps late rows after
    each; return (bursts, late rows)."""
    root = scratch_path(spark, "debounce-late")
    src, out, ck = (os.path.join(root, d) for d in ("src", "out", "ck"))
    for wave in waves:
        wave.write.mode("append").parquet(src)
        stream = spark.readStream.schema(waves[0].schema).parquet(src)
        _run(stream.writeStream.foreachBatch(deb.debounce_batches(out, gap, delay)).option("checkpointLocation", ck))
    return deb.read_bursts(spark, out, gap)


def run_ingest(spark: SparkSession, catalog, waves: list[DataFrame]):
    """Land feed documents (raw JSON text) wave by wave; each micro-batch runs
    the whole-table ingest against the catalogue as left by earlier batches."""
    root = scratch_path(spark, "ingest")
    src, out, ck = (os.path.join(root, d) for d in ("src", "out", "ck"))
    for wave in waves:
        wave.select("raw").write.mode("append").text(src)
        stream = ing.feed_stream(spark, src)
        _run(stream.writeStream.foreachBatch(ing.ingest_batches(catalog, out))
             .option("checkpointLocation", ck))
    return ing.read_state(spark, catalog, out)
