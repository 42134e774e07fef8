import pytest
from pyspark.sql import functions as F

from fixtures import catalog, lit_ts, rows
from tagrack.operators import detail, integrity, summaries, users


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(
        spark,
        brands=[(1, "Acme"), (2, "Zed")],
        items=[(1, "Coat", 1, 1, 4.5), (2, "coat", 2, None, None), (3, "Hat", 2, None, 3.0),
               (4, "Hat", 2, None, 2.0), (5, "Scarf", None, None, 1.0)],
        tags=[(1, "warm")], item_tags=[(1, 1), (1, 2), (1, 3)],
        images=[(1, "c1.jpg"), (2, "c2.jpg")], item_images=[(1, 2), (1, 1)],
        skus=[(10, 1, "L"), (11, 1, "xs"), (12, 1, None), (13, 1, "XXL"), (20, 2, "M")])


def test_infer_and_resolve(spark, cat):
    r = spark.createDataFrame([(1, "COAT", None), (2, None, "Acme"), (3, "hat", "zed"), (4, "nope", "Acme"),
                               (5, "Scarf", None), (6, "coat", "ZED")],
                              "request_id long, base_item_name string, brand_name string")
    assert rows(detail.infer_brand(r, cat)) == [(1, "Acme"), (2, "Acme"), (3, "zed"), (4, "Acme"),
                                                (5, None), (6, "ZED")]
    got = rows(detail.resolve_items(r, cat), "request_id", "base_item_id", "status")
    assert got == [(1, 1, "ok"), (2, None, "missing_name"), (3, 3, "ambiguous"), (4, None, "missing"),
                   (5, None, "no_brand"), (6, 2, "ok")]


def test_images_sizes_and_detail(spark, cat):
    imgs = rows(detail.item_images(cat))
    assert imgs[0] == (1, 2, "c1.jpg,c2.jpg") and imgs[1] == (2, 0, "")
    stock = spark.createDataFrame([(10, 3), (11, 0), (13, -2)], "item_id long, stock_quantity long")
    av = rows(detail.size_availability(cat.sku, stock), "base_item_id", "basic_size", "relative_order", "in_stock")
    assert av == [(1, "L", 4, True), (1, "XXL", 6, False), (1, "xs", 1, False), (2, "M", 3, False)]
    r = spark.createDataFrame([(1, "coat", "acme"), (2, "Hat", None), (3, None, None)],
                              "request_id long, base_item_name string, brand_name string")
    d = {x["request_id"]: x for x in detail.item_detail(r, cat, stock).collect()}
    assert d[1]["status"] == "ok" and d[1]["sizes"] == "xs:false|L:true|XXL:false"
    assert d[1]["image_urls"] == "c1.jpg,c2.jpg" and d[1]["similar"] == "coat~Zed~|Hat~Zed~"
    assert d[1]["item_name"] == "coat" and d[1]["brand_name"] == "acme"
    assert d[2]["status"] == "ambiguous" and d[2]["sizes"] == "" and d[2]["more_from_brand"] == "coat~Zed~"
    assert d[3]["status"] == "missing_name" and d[3]["description"] is None


@pytest.mark.parametrize("most", [2_000, 5])
def test_sign_ups_equal_a_walk_in_order(spark, monkeypatch, most):
    """Chains of clashes, one giant group, repeated pairs; folded whole and in small groups."""
    import random
    monkeypatch.setattr(users, "REPLAY_ROWS", most)
    rng = random.Random(most)
    asked = [(f"u{rng.randint(1, 12)}", f"M{rng.randint(1, 12)}@x.io") for _ in range(40)]
    asked += [(f"c{i // 2}", f"d{(i + 1) // 2}@x.io") for i in range(12)]  # each clashes with the one before
    asked += [("alone", "alone@x.io")]
    rng.shuffle(asked)
    names, mails, want = set(), set(), {}
    for n, (u, m) in enumerate(asked):
        ok = u not in names and m.lower() not in mails
        want[n] = "ok" if ok else "duplicate_in_batch"
        if ok:
            names.add(u)
            mails.add(m.lower())
    s = spark.createDataFrame([(n, "a", "b", u, m) for n, (u, m) in enumerate(asked)],
                              "seq long, first_name string, last_name string, username string, email string")
    _new, statuses = users.accepted_signups(users_df(spark), s)
    assert {r["seq"]: r["status"] for r in statuses.collect()} == want


def test_delete_cascade_and_restrict(spark, cat):
    ledger = spark.createDataFrame([(10, 5)], "item_id long, delta_quantity long")
    ids = spark.createDataFrame([(1,), (2,), (3,), (99,)], "base_item_id long")
    new, status = integrity.delete_base_items(cat, ledger, ids)
    assert rows(status) == [(1, "restricted"), (2, "ok"), (3, "ok"), (99, "missing")]
    assert [r[0] for r in rows(new.base_item, "base_item_id")] == [1, 4, 5]
    assert rows(new.tag_item) == [(1, 1)] and rows(new.sku, "item_id") == [(10,), (11,), (12,), (13,)]


def test_registered_deletion_sees_the_whole_ledger(spark, sf_dir, tmp_path):
    from pathlib import Path

    from tagrack.plans.registry import QUERIES
    for t in Path(sf_dir).iterdir():
        if t.name != "lineitem.parquet":
            (tmp_path / t.name).symlink_to(t)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.where("l_partkey % 3 <> 0").write.parquet(f"{tmp_path}/lineitem.parquet")  # every third item is free
    got = {r["base_item_id"]: r["status"] for r in QUERIES["delete_base_items"](spark, str(tmp_path)).collect()}
    parts = {r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect()}
    used = {r[0] for r in lines.select("l_partkey").distinct().collect() if r[0] % 3}
    assert got == {i: "missing" if i not in parts else "restricted" if i in used else "ok" for i in got}
    assert set(got.values()) == {"missing", "restricted", "ok"}


def test_rating_buckets_bounds(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(1, Decimal(x)) if x is not None else (1, None)
                                for x in ["3.2", "3.25", "3.74", "3.75", "0", "5", None]],
                               "brand_id int, rating decimal(3,2)")
    got = rows(summaries.rating_buckets(df), "full_stars", "half_star", "empty_stars", "n_items")
    assert got == [(0, 0, 5, 1), (3, 0, 2, 2), (3, 1, 1, 2), (5, 0, 0, 1)]


def users_df(spark):
    return spark.createDataFrame(
        [(1, "A", "B", "ann", "ann@x.io", True, False), (2, "C", "D", "bob", "bob@x.io", False, True)],
        "site_user_id long, first_name string, last_name string, username string, email string, "
        "is_staff boolean, is_admin boolean")


def test_register_users(spark):
    s = spark.createDataFrame(
        [(1, "a", "b", "carl", "bad email"), (2, "a", "b", "Ann", "ANN@X.IO"), (3, "a", "b", "Ann", "ann2@x.io"),
         (4, "a", "b", "ann", "new@x.io"), (5, "a", "b", "dan", "d@x.io"), (6, "a", "b", "eve", "d@x.io"),
         (7, "a", "b", "eve", "e@x.io"), (8, None, "b", "fay", "f@x.io")],
        "seq long, first_name string, last_name string, username string, email string")
    state, st = users.register_users(users_df(spark), s)
    assert rows(st, "seq", "status", "site_user_id") == [
        (1, "bad_email", None), (2, "email_taken", None), (3, "ok", 3), (4, "username_taken", None),
        (5, "ok", 4), (6, "duplicate_in_batch", None), (7, "ok", 5), (8, "missing_field", None)]
    assert state.count() == 5
    assert rows(summaries.users_by_role(users_df(spark))) == [("Admin", 1), ("Staff", 1)]


def test_sessions(spark):
    opens = spark.createDataFrame(
        [(1, 1, "t1", "2024-01-01 10:00:00"), (2, 1, "t2", "2024-01-02 10:00:00"),
         (3, 2, "t3", "2024-01-01 00:00:00")],
        "session_id long, site_user_id long, session_token string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    s = users.open_sessions(None, opens)
    assert rows(s, "site_user_id", "session_token") == [(1, "t2"), (2, "t3")]
    act = users.active_sessions(s, users_df(spark), lit_ts("2024-01-02 00:00:00"))
    assert rows(act, "session_token", "username") == [("t2", "ann")]   # t3 expires exactly then
    closed = users.close_sessions(s, spark.createDataFrame([("t2",), ("zz",)], "session_token string"))
    assert rows(closed, "session_token") == [("t3",)]


def test_closets(spark, cat):
    u = users_df(spark)
    closets = spark.createDataFrame([(10, 1, "Fav"), (11, 2, "Fav")], "closet_id long, site_user_id long, name string")
    items = spark.createDataFrame([(10, 1), (10, 3), (11, 2)], "closet_id long, item_id long")
    adds = spark.createDataFrame([(1, "ann", "Fav"), (2, "ann", "fav"), (3, "ann", "fav"), (4, "zoe", "x"),
                                  (5, "bob", "Summer")], "seq long, username string, closet_name string")
    cl, st = users.add_closets(closets, u, adds, lit_ts("2024-01-01 00:00:00"))
    assert rows(st) == [(1, "duplicate", None), (2, "ok", 12), (3, "duplicate", None),
                        (4, "unknown_user", None), (5, "ok", 13)]
    add_items = spark.createDataFrame(
        [(1, "ann", "Fav", "coat", "ACME"), (2, "ann", "Fav", "hat", "zed"), (3, "ann", "Fav", "hat", "zed"),
         (4, "ann", "nope", "hat", "zed"), (5, "zoe", "Fav", "hat", "zed"), (6, "bob", "Fav", "cap", "zed"),
         (7, "ann", "fav", "COAT", "zed"), (8, "ann", "fav", "coat", "Zed")],
        "seq long, username string, closet_name string, base_item_name string, brand_name string")
    ci, st2 = users.add_items_to_closets(cl, items, u, cat, add_items, lit_ts("2024-01-01 00:00:00"))
    assert rows(st2, "seq", "status") == [(1, "already_present"), (2, "already_present"),
                                          (3, "already_present"), (4, "unknown_closet"),
                                          (5, "unknown_user"), (6, "unknown_item"), (7, "ok"),
                                          (8, "already_present")]
    assert rows(ci, "closet_id", "item_id") == [(10, 1), (10, 3), (11, 2), (12, 2)]
    listing = rows(users.user_closets(u, cl, items, cat), "username", "closet_rank", "closet_name",
                   "item_rank", "item_name")
    assert listing == [("ann", 1, "Fav", 1, "Coat"), ("ann", 1, "Fav", 2, "Hat"), ("ann", 2, "fav", None, None),
                       ("bob", 1, "Fav", 1, "coat"), ("bob", 2, "Summer", None, None)]
    rem = spark.createDataFrame([(1, "ann", "Fav"), (2, "ann", "Fav"), (3, "zoe", "Fav")],
                                "seq long, username string, closet_name string")
    c2, ci2, st3 = users.remove_closets(cl, items, u, rem)
    assert rows(st3) == [(1, "ok", 10), (2, "unknown_closet", None), (3, "unknown_user", None)]
    assert rows(ci2) == [(11, 2)]
    assert rows(users.closet_item_counts(c2, ci2)) == [(11, 1), (12, 0), (13, 0)]


def test_sign_in_by_email(spark):
    logins = spark.createDataFrame(
        [(5, "ANN@x.io", "tA", "2024-01-03 00:00:00"), (6, "nobody@x.io", "tZ", "2024-01-03 00:00:00")],
        "seq long, email string, session_token string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    old = spark.createDataFrame([(1, 1, "t-old", "2024-01-01 00:00:00")],
                                "session_id long, site_user_id long, session_token string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    s, st = users.sign_in(old, users_df(spark), logins)
    assert rows(st) == [(5, "ok", 1), (6, "unknown_email", None)]
    assert rows(s, "site_user_id", "session_token") == [(1, "tA")]


def test_images_and_ids_are_not_sent_through_the_driver(spark, cat):
    from tagrack.plans.checks import plan_text
    from tagrack.plans.materialize import written
    # small files, as Spark would send through the driver
    cat = cat.with_(**{t: written(getattr(cat, t), "small") for t in ("brand", "base_item", "image", "base_item_image")})
    images = detail.item_images(cat)
    assert "Broadcast" not in plan_text(images, "simple")
    r = spark.createDataFrame([(1, "COAT", None)], "request_id long, base_item_name string, brand_name string")
    assert plan_text(detail.resolve_items(r, cat), "simple").count("SortMergeJoin") >= 3


def test_adding_to_closets_is_computed_once_for_rows_and_statuses(spark, cat):
    from tagrack.plans.checks import plan_text
    u = spark.createDataFrame([(1, "ann")], "site_user_id long, username string")
    closets = spark.createDataFrame([(10, 1, "Fav")], "closet_id long, site_user_id long, name string")
    items = spark.createDataFrame([(10, 1)], "closet_id long, item_id long").withColumn("added_at", lit_ts("2024-01-01 00:00:00"))
    adds = spark.createDataFrame([(1, "ann", "Fav", "hat", "Zed"), (2, "ann", "Fav", "coat", "Acme")],
                                 "seq long, username string, closet_name string, base_item_name string, brand_name string")
    new, statuses = users.new_closet_items(closets, items, u, cat, adds, lit_ts("2024-01-02 00:00:00"))
    assert rows(new, "closet_id", "item_id") == [(10, 3)] and rows(statuses, "seq", "status") == [(1, "ok"), (2, "already_present")]
    assert "Join" not in plan_text(new, "simple") and "Join" not in plan_text(statuses, "simple")
