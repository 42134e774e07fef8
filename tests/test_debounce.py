from pyspark.sql import functions as F

from fixtures import rows
from tagrack.streaming import debounce, runner


def log(spark, *rs):
    return spark.createDataFrame(list(rs), "user_id long, ts string, query string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_default_gap_is_150ms_and_inclusive(spark):
    lg = log(spark, (1, "2024-01-01 00:00:00.000", "d"), (1, "2024-01-01 00:00:00.100", "dr"),
             (1, "2024-01-01 00:00:00.250", "dre"), (1, "2024-01-01 00:00:00.401", "dres"),
             (2, "2024-01-01 00:00:00.000", "x"))
    got = rows(debounce.debounce(lg), "user_id", "last_query", "n_queries")
    assert got == [(1, "dre", 3), (1, "dres", 1), (2, "x", 1)]


def test_stream_equals_batch(spark):
    lg = log(spark, (1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 03:00:00", "ab"),
             (1, "2024-01-01 12:00:00", "c"), (2, "2024-01-02 00:00:00", "z"))
    batch = rows(debounce.debounce(lg, "6 hours"))
    stream = rows(runner.run_debounce(spark, lg, "6 hours", "1 hour"))
    assert stream == batch and len(batch) == 3


def test_late_rows_behind_the_watermark_are_dropped(spark):
    first = log(spark, (1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 10:00:00", "b"))
    late = log(spark, (1, "2024-01-01 00:00:30", "late"), (2, "2024-01-01 09:59:00", "ok"))
    got = rows(runner.run_debounce(spark, [first, late], "1 minute", "30 minutes"),
               "user_id", "last_query", "n_queries")
    # watermark after wave 1 = 10:00 - 30 min: user 1's 00:00:30 row is late, user 2's 09:59 is not
    assert got == [(1, "a", 1), (2, "b", 2)]


def test_queries_of_one_instant_go_by_event_id(spark):
    t = "2024-01-01 00:00:00"
    lg = spark.createDataFrame([(5, 1, t, "late"), (9, 1, t, "a"), (2, 1, t, "z")], "event_id long, user_id long, ts string, query string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert rows(debounce.debounce(lg), "last_query", "n_queries") == [("a", 3)]
    assert rows(runner.run_debounce(spark, lg, "1 minute", "1 hour"), "last_query") == [("a",)]


def late_log(spark, rs):
    return spark.createDataFrame([(i, u, f"2024-01-01 {t}", f"q{i}") for i, u, t in rs], "event_id long, user_id long, ts string, query string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_bursts_and_late_rows_are_all_rows(spark):
    import datetime as dt
    import random
    rng = random.Random(4)
    clock = lambda m: f"{m // 60:02d}:{m % 60:02d}:00"
    # three waves moving on in time, each with some rows from long before
    waves = [[(100 * w + n, rng.randint(1, 3), clock(max(0, 300 * w + rng.randint(-250 if n % 4 == 0 else 0, 299)))) for n in range(40)]
             for w in range(3)]
    bursts, late = runner.run_debounce_late(spark, [late_log(spark, w) for w in waves], "10 minutes", "30 minutes")
    at = lambda t: dt.datetime.fromisoformat(f"2024-01-01 {t}")
    latest, kept, dropped = None, [], []
    for w in waves:
        for i, u, t in w:
            behind = latest is not None and at(t) < latest - dt.timedelta(minutes=30)
            (dropped if behind else kept).append((i, u, t))
        latest = max([at(t) for _, _, t in w] + ([latest] if latest else []))
    assert dropped and sorted(r["event_id"] for r in late.collect()) == sorted(i for i, _, _ in dropped)
    assert rows(bursts) == rows(debounce.debounce(late_log(spark, kept), "10 minutes"))
    assert sum(r["n_queries"] for r in bursts.collect()) + len(dropped) == 120


def test_a_debounce_batch_that_comes_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    write = debounce.debounce_batches(out, "10 minutes", "30 minutes")
    first = late_log(spark, [(1, 1, "00:00:00"), (2, 1, "00:05:00"), (3, 2, "02:00:00")])
    second = late_log(spark, [(4, 2, "02:05:00"), (5, 1, "00:06:00")])
    for batch, n in ((first, 0), (first, 0), (second, 1), (second, 1)):
        write(batch, n)
    bursts, late = debounce.read_bursts(spark, out, "10 minutes")
    assert rows(bursts, "user_id", "last_query", "n_queries") == [(1, "q2", 2), (2, "q4", 2)]
    assert rows(late, "event_id") == [(5,)]
    write(late_log(spark, []), 2)  # an empty batch
    assert debounce.read_bursts(spark, out, "10 minutes")[0].count() == 2
