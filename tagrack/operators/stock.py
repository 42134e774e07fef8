"""Event-sourced stock ledger: validate, fold events into deltas, levels.

An event is ``audit`` (set stock to q), ``ship-in`` (+q), ``ship-out`` or
``scrap`` (-q). Deltas are what the reference's serial loop would insert.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EVENT_TYPES
from ..plans.materialize import materialize

# Event order inside one SKU for the driver-bound ledger (free of ties).
BOUND_ORDER = ["transaction_date", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def validate_stock_events(events: DataFrame, sku: DataFrame) -> DataFrame:
    """``status`` per event: ok, invalid_event, null_quantity,
    negative_audit or unknown_item (first failing check wins)."""
    ev = F.col("transaction_event")
    known = sku.select("item_id").distinct().withColumn("_known", F.lit(True))
    x = events.join(known, "item_id", "left")
    status = (F.when(ev.isNull() | ~ev.isin(*EVENT_TYPES), F.lit("invalid_event"))
              .when(F.col("quantity").isNull(), F.lit("null_quantity"))
              .when((ev == "audit") & (F.col("quantity") < 0), F.lit("negative_audit"))
              .when(F.col("_known").isNull(), F.lit("unknown_item"))
              .otherwise(F.lit("ok")))
    return x.withColumn("status", status).drop("_known")


def signed_quantity() -> Column:
    ev, q = F.col("transaction_event"), F.col("quantity")
    return F.when(ev.isin("ship-out", "scrap"), -q).otherwise(q)


# A hash class of SKUs with more events than this is folded in buckets; classes of one count.
HOT_EVENTS, SKU_CLASSES = 1_000_000, 1 << 16


def _sku_class() -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(SKU_CLASSES)).cast("int")


def fold_stock_events(events: DataFrame, order: Sequence[str], bucket: Column | None = None,
                      opening: DataFrame | None = None) -> DataFrame:
    """Add ``delta_quantity`` and ``stock_after`` to each valid event.

    Per SKU in ``order``: an audit sets the stock to q, other events add their
    signed q. ``opening`` (item_id, stock_quantity) is the stock before the
    first event (else 0).

    SKUs of few events are folded by one window per SKU, so events move once, by
    SKU, and not at all if a join has put them there. One count per hash class (summed
    before the shuffle) tells the classes that hold a SKU of very many events; those
    are folded in buckets, at any size. ``bucket`` asks for buckets throughout.
    """
    if bucket is not None:
        return _fold_in_buckets(events, order, bucket, opening)
    hot = [r["c"] for r in events.groupBy(_sku_class().alias("c")).agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > HOT_EVENTS).select("c").collect()]  # at most events / HOT_EVENTS numbers
    if not hot:
        return _fold_by_sku(events, order, opening)
    crowded = _sku_class().isin(hot)
    return _fold_by_sku(events.filter(~crowded), order, opening).unionByName(
        _fold_in_buckets(events.filter(crowded), order, None, opening))


def _fold_by_sku(events: DataFrame, order: Sequence[str], opening: DataFrame | None) -> DataFrame:
    """The fold by one window per SKU: running sums, less those before the last audit."""
    w = Window.partitionBy("item_id").orderBy(*[F.col(c).asc() for c in order])
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = signed_quantity()
    x = events.filter(F.col("item_id").isNotNull())
    if opening is not None:
        x = x.join(opening.select("item_id", F.col("stock_quantity").cast("long").alias("_open")), "item_id", "left")
    else:
        x = x.withColumn("_open", F.lit(None).cast("long"))
    x = x.select(*events.columns, F.coalesce("_open", F.lit(0).cast("long")).alias("_open"),
                 F.coalesce(F.sum(v).over(running), F.lit(0)).alias("_sum"), F.count(v).over(running).alias("_n"))
    # sum and count of quantities before the last audit
    before = F.when(F.col("transaction_event") == "audit", F.struct(
        (F.col("_sum") - F.coalesce(v, F.lit(0))).alias("sum"), (F.col("_n") - v.isNotNull().cast("int")).alias("n")))
    x = x.withColumn("_before", F.last(before, ignorenulls=True).over(running))
    since = F.when(F.col("_n") > F.coalesce("_before.n", F.lit(0)), F.col("_sum") - F.coalesce("_before.sum", F.lit(0)))
    run = since + F.when(F.col("_before").isNull(), F.col("_open")).otherwise(F.lit(0))
    x = x.withColumn("stock_after", run.cast("long"))
    prev = F.coalesce(F.lag("stock_after").over(w), F.col("_open"))
    return x.withColumn("delta_quantity", (F.col("stock_after") - prev).cast("long")).drop("_open", "_sum", "_n", "_before")


def _fold_in_buckets(events: DataFrame, order: Sequence[str], bucket: Column | None = None,
                      opening: DataFrame | None = None) -> DataFrame:
    """The fold where a SKU may hold a large share of the events.

    Events are cut into order-monotone buckets so no window spans a
    whole SKU: each bucket is reduced to a summary (ends in reset-to-value or
    add-value), a running fold over the summaries gives the stock entering
    each bucket, then each bucket replays its rows from there.

    Without an explicit ``bucket`` the buckets are the partitions of one
    range-partitioned sort on (item_id, order), written once: Spark samples
    the keys, so a SKU with a third of all events spans many partitions and
    no bucket exceeds a partition, whatever the skew.
    """
    is_audit = (F.col("transaction_event") == "audit").cast("int")
    if bucket is None:
        keys = [F.col("item_id").asc()] + [F.col(c).asc() for c in order]
        events = materialize(events.orderBy(*keys).withColumn("_b", F.spark_partition_id()))
        bucket = F.col("_b")
    x = events.withColumns({"_b": bucket, "_v": signed_quantity(), "_a": is_audit})
    o = [F.col(c).asc() for c in order]
    w_b = Window.partitionBy("item_id", "_b").orderBy(*o)
    running = w_b.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_lseg", F.sum("_a").over(running))
    x = x.withColumn("_lrun", F.sum("_v").over(
        Window.partitionBy("item_id", "_b", "_lseg").orderBy(*o)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # bucket summary: (ends_after_audit, value) of its last row
    summ = (x.groupBy("item_id", "_b")
            .agg(F.max_by(F.struct("_lseg", "_lrun"), F.struct(*order)).alias("_last"))
            .select("item_id", "_b", (F.col("_last._lseg") > 0).cast("int").alias("_ba"),
                    F.col("_last._lrun").alias("_tail")))
    if opening is not None:
        summ = summ.join(opening.select("item_id", F.col("stock_quantity").alias("_open")),
                         "item_id", "left")
    else:
        summ = summ.withColumn("_open", F.lit(None).cast("long"))
    summ = summ.withColumn("_open", F.coalesce(F.col("_open").cast("long"), F.lit(0).cast("long")))
    w_i = Window.partitionBy("item_id").orderBy("_b")
    summ = summ.withColumn("_bseg", F.sum("_ba").over(
        w_i.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summ = summ.withColumn("_exit", F.sum("_tail").over(
        Window.partitionBy("item_id", "_bseg").orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        + F.when(F.col("_bseg") == 0, F.col("_open")).otherwise(F.lit(0)))
    summ = summ.withColumn("_enter", F.coalesce(F.lag("_exit").over(w_i), F.col("_open")))
    enter = summ.select(F.col("item_id").alias("_ei"), F.col("_b").alias("_eb"), "_enter")
    y = x.join(enter, (F.col("item_id") == F.col("_ei")) & F.col("_b").eqNullSafe(F.col("_eb"))) \
        .drop("_ei", "_eb")  # a NULL bucket (missing date) is a bucket too
    run = F.col("_lrun") + F.when(F.col("_lseg") == 0, F.col("_enter")).otherwise(F.lit(0))
    y = y.withColumn("stock_after", run.cast("long"))
    prev = F.coalesce(F.lag("stock_after").over(w_b), F.col("_enter"))
    return (y.withColumn("delta_quantity", (F.col("stock_after") - prev).cast("long"))
            .drop("_b", "_v", "_a", "_lseg", "_lrun", "_enter"))


def stock_levels(ledger: DataFrame) -> DataFrame:
    """(item_id, stock_quantity) = sum of deltas; may be negative; SKUs
    without ledger rows are absent. Partial sums combine map-side."""
    return ledger.groupBy("item_id").agg(F.sum("delta_quantity").cast("long").alias("stock_quantity"))


def closing_levels(events: DataFrame, order: Sequence[str], opening: DataFrame | None = None) -> DataFrame:
    """U17 straight from events: (item_id, stock_quantity) without a sort.

    A SKU's stock is the quantity of its last audit plus the signed quantities
    after it: one map-side ``max`` per SKU, then one map-side sum. With
    ``opening`` (item_id, stock_quantity), the stock before these events, a SKU
    without an audit goes on from there and SKUs without events keep theirs.
    """
    at = F.struct(*order)
    last = events.filter(F.col("transaction_event") == "audit").groupBy(F.col("item_id").alias("_li")).agg(F.max(at).alias("_last"))
    x = events.join(last, F.col("item_id") == F.col("_li"), "left")
    x = x.filter(F.col("_last").isNull() | (at >= F.col("_last")))
    if opening is None:
        return x.groupBy("item_id").agg(F.sum(signed_quantity()).cast("long").alias("stock_quantity"))
    change = x.groupBy("item_id").agg(F.sum(signed_quantity()).alias("_change"), F.max(F.col("_li").isNotNull()).alias("_reset"))
    before = F.when(F.col("_reset"), F.lit(0)).otherwise(F.coalesce("stock_quantity", F.lit(0)))
    return opening.select("item_id", "stock_quantity").join(change, "item_id", "full").select(
        "item_id", (before + F.coalesce("_change", F.lit(0))).cast("long").alias("stock_quantity"))


def levels_at(snapshots: DataFrame, events: DataFrame, order: Sequence[str], at: Column) -> DataFrame:
    """Stock levels right before time ``at`` (a literal): those of the nearest
    snapshot at or before it, carried on by the events in between.

    ``snapshots`` (mark, item_id, stock_quantity) holds levels right before each
    mark, as ``closing_levels`` gives them; written by mark, only the nearest
    one is read, and of the events only those from its mark on. Without such a
    snapshot the whole history is folded. Events without a time never count.
    """
    mark = snapshots.filter(F.col("mark") <= at).agg(F.max("mark")).first()[0]
    tail = events.filter(F.col("transaction_date") < at)
    if mark is None:
        return closing_levels(tail, order)
    since = F.lit(mark).cast(snapshots.schema["mark"].dataType)
    return closing_levels(tail.filter(F.col("transaction_date") >= since), order,
                          snapshots.filter(F.col("mark") == since).select("item_id", "stock_quantity"))


def apply_stock_events(ledger: DataFrame, events: DataFrame, sku: DataFrame,
                       order: Sequence[str], bucket: Column | None = None,
                       opening: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate new events, fold the valid ones on top of the ledger's
    stock, append. Returns (new ledger, rejected events with status).
    ``opening`` (item_id, stock_quantity) is the ledger's stock where a snapshot
    holds it; otherwise it is summed from the whole ledger."""
    new, rejects = fold_new_events(events, sku, order, stock_levels(ledger) if opening is None else opening, bucket)
    return ledger.unionByName(new.select(*ledger.columns)), rejects


def fold_new_events(events: DataFrame, sku: DataFrame, order: Sequence[str], opening: DataFrame,
                    bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """U20 without the old ledger: (rows to append, rejected events with status)."""
    checked = validate_stock_events(events, sku)
    valid = checked.filter(F.col("status") == "ok").drop("status")
    return fold_stock_events(valid, order, bucket, opening=opening), checked.filter(F.col("status") != "ok")
