from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import rows
from tagrack.operators import stock
from tagrack.streaming import runner

SCHEMA = "item_id long, transaction_event string, quantity long, seq long"


def replay(events, opening=None):
    """Sequential reference: the per-call loop of the reference, one row at a time."""
    cur = dict(opening or {})
    out = []
    for item, ev, q, seq in sorted(events, key=lambda e: (e[0], e[3])):
        old = cur.get(item, 0)
        new = q if ev == "audit" else (old - q if ev in ("ship-out", "scrap") else old + q)
        cur[item] = new
        out.append((item, seq, new, new - old))
    return sorted(out), cur


def fold(spark, events, opening=None, width=3):
    df = spark.createDataFrame(events, SCHEMA)
    op = None
    if opening:
        op = spark.createDataFrame(list(opening.items()), "item_id long, stock_quantity long")
    # tiny buckets (seq div width) so folds cross bucket borders
    res = stock.fold_stock_events(df, ["seq"], F.floor(F.col("seq") / width), op)
    return rows(res, "item_id", "seq", "stock_after", "delta_quantity")


def test_edge_sequence(spark):
    ev = [(1, "audit", 5, 1), (1, "ship-out", 7, 2), (1, "audit", 0, 3), (1, "audit", 4, 4),
          (1, "ship-in", 2, 5), (2, "scrap", 3, 1), (2, "audit", 1, 2), (3, "ship-in", 1, 9)]
    assert fold(spark, ev) == replay(ev)[0]
    assert fold(spark, ev, {1: 10, 2: -4}) == replay(ev, {1: 10, 2: -4})[0]


events_strategy = st.lists(
    st.tuples(st.integers(1, 4), st.sampled_from(["audit", "ship-in", "ship-out", "scrap"]),
              st.integers(0, 9)), min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events_strategy)
def test_fold_equals_sequential_replay(spark, evs):
    ev = [(i, e, q, n) for n, (i, e, q) in enumerate(evs)]
    assert fold(spark, ev, width=4) == replay(ev)[0]


def test_levels_are_last_running_stock(spark):
    ev = [(1, "audit", 5, 1), (1, "ship-out", 7, 2), (2, "ship-in", 3, 1), (2, "audit", 1, 2)]
    df = spark.createDataFrame(ev, SCHEMA)
    lv = rows(stock.stock_levels(stock.fold_stock_events(df, ["seq"], F.lit(0))))
    assert lv == sorted(replay(ev)[1].items())


def test_validation_codes(spark):
    ev = spark.createDataFrame(
        [(1, "audit", -1, 1), (1, "restock", 1, 2), (1, None, 1, 3), (9, "ship-in", 1, 4),
         (1, "ship-in", None, 5), (1, "ship-out", 2, 6)], SCHEMA)
    sku = spark.createDataFrame([(1, 1, "S")], "item_id long, base_item_id long, basic_size string")
    got = rows(stock.validate_stock_events(ev, sku), "seq", "status")
    assert got == [(1, "negative_audit"), (2, "invalid_event"), (3, "invalid_event"),
                   (4, "unknown_item"), (5, "null_quantity"), (6, "ok")]


def test_apply_appends_to_ledger(spark):
    sku = spark.createDataFrame([(1, 1, "S"), (2, 1, "M")], "item_id long, base_item_id long, basic_size string")
    old = stock.fold_stock_events(spark.createDataFrame([(1, "audit", 3, 1)], SCHEMA), ["seq"], F.lit(0))
    new = spark.createDataFrame([(1, "ship-out", 1, 2), (2, "ship-in", 4, 3), (7, "ship-in", 1, 4)], SCHEMA)
    ledger, rejects = stock.apply_stock_events(old, new, sku, ["seq"], F.lit(0))
    assert rows(stock.stock_levels(ledger)) == [(1, 2), (2, 4)]
    assert rows(rejects, "seq", "status") == [(4, "unknown_item")]


def test_stream_equals_batch_across_waves(spark):
    ev = [(1, "audit", 5, 1), (1, "ship-out", 7, 2), (2, "ship-in", 3, 3), (1, "ship-in", 1, 4),
          (2, "audit", 1, 5), (5000, "ship-in", 2, 6), (1, "bogus", 1, 7)]
    df = spark.createDataFrame(ev, SCHEMA)
    sku = spark.createDataFrame([(1, 1, "S"), (2, 1, "M"), (5000, 2, "L")],
                                "item_id long, base_item_id long, basic_size string")
    # shape the events like the bound ledger (its order columns), event order = l_orderkey
    full = df.select("item_id", "transaction_event", "quantity",
                     F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("transaction_date"),
                     F.col("seq").alias("l_orderkey"), F.lit(0).cast("long").alias("l_suppkey"),
                     F.lit(0.0).alias("l_quantity"), F.lit(0.0).alias("l_extendedprice"))
    waves = [full.filter("l_orderkey <= 3"), full.filter("l_orderkey > 3")]
    ledger, rejects = runner.run_ledger(spark, waves, sku, stock.BOUND_ORDER)
    got = rows(ledger, "item_id", "l_orderkey", "stock_after", "delta_quantity")
    valid = [e for e in ev if e[1] != "bogus"]
    assert got == replay(valid)[0]
    assert rows(rejects, "l_orderkey", "status") == [(7, "invalid_event")]


def test_null_bucket_rows_are_kept(spark):
    ev = [(1, "ship-in", 2, 1), (1, "audit", 5, 2), (1, "ship-out", 1, 3)]
    df = spark.createDataFrame(ev, SCHEMA)
    bucket = F.when(F.col("seq") == 1, F.lit(None)).otherwise(F.col("seq"))
    got = rows(stock.fold_stock_events(df, ["seq"], bucket), "item_id", "seq", "stock_after", "delta_quantity")
    assert got == replay(ev)[0]


def test_sort_buckets_with_a_hot_sku(spark):
    import random
    random.seed(3)
    evs = [(1 if random.random() < 0.5 else random.randint(2, 6),
            random.choice(["audit", "ship-in", "ship-out", "scrap"]), random.randint(0, 9), n)
           for n in range(600)]
    df = spark.createDataFrame(evs, SCHEMA).repartition(5)
    got = rows(stock.fold_stock_events(df, ["seq"]), "item_id", "seq", "stock_after", "delta_quantity")
    assert got == replay(evs)[0]


def test_closing_levels_carry_an_opening_on(spark):
    ev = [(1, "ship-out", 2, 1), (2, "audit", 4, 1), (2, "ship-in", 1, 2), (3, "ship-in", 5, 1)]
    opening = {1: 10, 2: 7, 9: 3}
    op = spark.createDataFrame(list(opening.items()), "item_id long, stock_quantity long")
    got = rows(stock.closing_levels(spark.createDataFrame(ev, SCHEMA), ["seq"], op))
    assert got == sorted(replay(ev, opening)[1].items())


def test_levels_at_a_time_come_from_the_nearest_snapshot(spark):
    ev = [(i % 3, ["ship-in", "audit", "scrap"][i % 7 % 3], i % 5, i) for i in range(60)]
    at = lambda n: F.lit(n)
    events = spark.createDataFrame(ev, SCHEMA).withColumn("transaction_date", F.col("seq"))
    marks = [(m, i, q) for m in (20, 40) for i, q in replay([e for e in ev if e[3] < m])[1].items()]
    snapshots = spark.createDataFrame(marks, "mark long, item_id long, stock_quantity long")
    for t in (5, 20, 33, 40, 55):
        want = sorted(replay([e for e in ev if e[3] < t])[1].items())
        assert rows(stock.levels_at(snapshots, events, ["seq"], at(t))) == want
    # what lies before the nearest mark is not read: without it the answer is the same
    late = events.filter("seq >= 40")
    assert rows(stock.levels_at(snapshots, late, ["seq"], at(55))) == sorted(replay([e for e in ev if e[3] < 55])[1].items())


SKUS = "item_id long, base_item_id long, basic_size string"


def test_stream_with_every_status_a_hot_sku_and_extra_columns(spark):
    import random
    rng = random.Random(8)
    kinds = ["audit", "ship-in", "ship-out", "scrap", "lost", None]
    ev = [(rng.choice([1, 1, 1, 2, 3, 99, None]), rng.choice(kinds), rng.choice([None, -2, 0, 3, 7]), n) for n in range(300)]
    df = spark.createDataFrame([(*e, f"note {e[3]}") for e in ev], SCHEMA + ", note string")
    sku = spark.createDataFrame([(i, 1, "S") for i in (1, 2, 3)], SKUS)
    status = {r["seq"]: r["status"] for r in stock.validate_stock_events(df, sku).collect()}
    assert set(status.values()) == {"ok", "invalid_event", "null_quantity", "negative_audit", "unknown_item"}
    waves = [df.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 75)) for lo in range(0, 300, 75)]
    ledger, rejects = runner.run_ledger(spark, waves, sku, ["seq"])
    valid = [e for e in ev if status[e[3]] == "ok"]
    assert rows(ledger, "item_id", "seq", "stock_after", "delta_quantity") == replay(valid)[0]
    assert {r["note"] for r in ledger.collect()} == {f"note {e[3]}" for e in valid}
    assert {r["seq"]: r["status"] for r in rejects.collect()} == {k: v for k, v in status.items() if v != "ok"}


def test_stream_batches_retried_and_started_from_snapshots(spark, tmp_path, monkeypatch):
    from tagrack.streaming import ledger as led
    monkeypatch.setattr(led, "SNAPSHOT_EVERY", 2)
    out = str(tmp_path / "out")
    ev = [(1 + n % 4, ["ship-in", "ship-out", "audit"][n % 5 % 3], n % 6, n) for n in range(80)]
    sku = spark.createDataFrame([(i, 1, "S") for i in range(1, 5)], SKUS)
    write = led.fold_batches(sku, ["seq"], out)
    for batch, lo in enumerate(range(0, 80, 10)):
        wave = spark.createDataFrame(ev[lo:lo + 10], SCHEMA)
        write(wave, batch)
        if batch in (3, 4):
            write(wave, batch)  # the mark was lost, the batch comes again
    got = rows(led.read_ledger(spark, out)[0], "item_id", "seq", "stock_after", "delta_quantity")
    assert got == replay(ev)[0]
    assert rows(led.read_levels(spark, out, 100)) == sorted(replay(ev)[1].items())
    last, snapshot = led._done(spark, out, 100)
    assert last == 7 and snapshot >= 5
    # a batch asks for its own divisions only
    one = spark.createDataFrame([(1,)], "item_id long").select(led._division().alias("d")).first()["d"]
    assert 1 in {r[0] for r in rows(led.read_levels(spark, out, 100, [one]))}


def test_stream_stays_in_the_jvm(spark, tmp_path):
    from tagrack.plans.checks import PYTHON_NODES, plan_text
    ev = spark.createDataFrame([(1, "audit", 5, 1)], SCHEMA)
    sku = spark.createDataFrame([(1, 1, "S")], SKUS)
    text = plan_text(stock.fold_stock_events(stock.validate_stock_events(ev, sku), ["seq"]))
    assert not any(n in text for n in PYTHON_NODES)


def test_fold_moves_events_once_and_crowded_skus_agree(spark, monkeypatch):
    import random
    from tagrack.plans.checks import plan_text
    rng = random.Random(5)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["audit", "ship-in", "ship-out", "scrap"]),
               rng.choice([0, 4, 9, 30]), n) for n in range(200)]
    df = spark.createDataFrame(events, SCHEMA)
    op = spark.createDataFrame([(1, 50), (9, 3)], "item_id long, stock_quantity long")
    want = replay([e for e in events if e[0] is not None], {1: 50})[0]
    plain = stock.fold_stock_events(df, ["seq"], opening=op)
    assert rows(plain, "item_id", "seq", "stock_after", "delta_quantity") == want
    at_place = plan_text(stock.fold_stock_events(df.repartition("item_id"), ["seq"]), "simple")
    assert at_place.count("Exchange") == 1, at_place
    monkeypatch.setattr(stock, "HOT_EVENTS", 60)  # SKU 1 alone is crowded
    assert rows(stock.fold_stock_events(df, ["seq"], opening=op), "item_id", "seq", "stock_after", "delta_quantity") == want


def test_fold_of_missing_quantities(spark):
    df = spark.createDataFrame([(1, "ship-in", None, 1), (1, "ship-in", 5, 2), (1, "audit", None, 3), (1, "ship-in", 2, 4)], SCHEMA)
    got = rows(stock.fold_stock_events(df, ["seq"]), "seq", "stock_after", "delta_quantity")
    assert got == [(1, None, None), (2, 5, 5), (3, None, None), (4, 2, 2)]
