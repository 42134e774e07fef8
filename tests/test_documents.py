import json

import pytest

from fixtures import catalog
from tagrack.model import BROWSE_REQUEST_SCHEMA
from tagrack.operators import documents


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(
        spark,
        brands=[(1, "Acme"), (2, "Zed")],
        items=[(1, "Coat", 1, 1, 4.5), (2, "coat", 2, None, None), (3, "Hat", 2, None, 3.0)],
        tags=[(1, "warm")], item_tags=[(1, 1), (1, 2), (1, 3)],
        images=[(1, "c1.jpg"), (2, "c2.jpg")], item_images=[(1, 2), (1, 1)],
        skus=[(10, 1, "L"), (11, 1, "xs")])


def docs(df, key):
    return {r[key]: json.loads(r["doc"]) for r in df.collect()}


def test_browse_documents(spark, cat):
    r = spark.createDataFrame([(1, 1, 2, ["WARM"]), (2, 1, 24, ["nope"])], BROWSE_REQUEST_SCHEMA)
    d = docs(documents.browse_documents(r, cat), "request_id")
    assert d[1]["total_pages"] == 2 and [i["item_name"] for i in d[1]["items"]] == ["Coat", "coat"]
    assert d[1]["items"][0] == {"brand_name": "Acme", "item_name": "Coat", "description": "desc 1",
                                "thumbnail_url": "c1.jpg"}
    assert d[2] == {"total_pages": 0, "items": []}


def test_search_documents(spark, cat):
    q = spark.createDataFrame([(1, "oa"), (2, "zz")], "query_id long, q string")
    d = docs(documents.search_documents(q, cat), "query_id")
    assert d[1] == {"tags": [], "brands": [], "items": ["Coat", "coat"]}
    assert d[2] == {"tags": [], "brands": [], "items": []}


def test_detail_documents(spark, cat):
    r = spark.createDataFrame([(1, "coat", "acme"), (2, None, None)],
                              "request_id long, base_item_name string, brand_name string")
    stock = spark.createDataFrame([(10, 2)], "item_id long, stock_quantity long")
    d = docs(documents.detail_documents(r, cat, stock), "request_id")
    assert d[1]["image_urls"] == ["c1.jpg", "c2.jpg"] and d[1]["rating"] == 4.5
    assert d[1]["item_specific_details"] == [{"size": "xs", "in_stock": False}, {"size": "L", "in_stock": True}]
    assert [x["item_name"] for x in d[1]["more_like"]["similar_items"]] == ["coat", "Hat"]
    assert d[1]["more_like"]["more_from_brand"] == []
    assert d[2] == {"error": "missing_name"}


def test_index_documents_are_cut_into_blocks(spark):
    from tagrack.functions.text import name_key
    names = [f"Name {i:03d}" for i in range(25)] + ["9 Lives", "Élan"]
    brand = spark.createDataFrame(list(enumerate(names)), "brand_id int, name string").withColumn("name_key", name_key("name"))
    got = {(r["initial"], r["block"]): json.loads(r["doc"]) for r in documents.index_documents(brand, block=10).collect()}
    assert got == {("N", 0): {"N": names[:10]}, ("N", 1): {"N": names[10:20]}, ("N", 2): {"N": names[20:25]},
                   ("#", 0): {"#": ["9 Lives"]}, ("E", 0): {"E": ["Élan"]}}


def test_closet_documents_and_closets_by_name(spark, cat):
    from tagrack.operators import users
    from fixtures import lit_ts, rows
    people = spark.createDataFrame([(1, "ann"), (2, "bob")], "site_user_id long, username string")
    closets = spark.createDataFrame([(7, 1, "Work"), (8, 1, "Empty")], "closet_id long, site_user_id long, name string").withColumn(
        "created_at", lit_ts("2024-01-02 03:04:05"))
    entries = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "closet_id long, item_id long").withColumn("added_at", lit_ts("2024-02-03 00:00:00"))
    full = cat.with_(site_user=people, closet=closets, closet_item=entries)
    asked = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "Ann"), (4, "ann"), (5, None)], "request_id long, username string")
    flat = users.closets_by_name(asked, people, closets, entries, full)
    assert [r[:2] for r in rows(flat, "request_id", "status")] == [
        (1, "empty"), (1, "item"), (1, "item"), (1, "item"), (2, "no_closets"), (3, "unknown_user"),
        (4, "empty"), (4, "item"), (4, "item"), (4, "item"), (5, "unknown_user")]
    got = {(r["request_id"], r["closet_rank"], r["block"]): json.loads(r["doc"]) for r in documents.closet_documents(asked, full, block=2).collect()}
    assert got[(2, None, 0)] == [] and got[(3, None, 0)] == {"error": "unknown_user"}
    assert got[(1, 1, 0)] == {"closet_id": 8, "name": "Empty", "created_at": "2024-01-02T03:04:05", "items": []}
    items = got[(1, 2, 0)]["items"] + got[(1, 2, 1)]["items"]
    assert [(i["base_item_name"], i["brand_name"]) for i in items] == [("Coat", "Acme"), ("coat", "Zed"), ("Hat", "Zed")]
    assert items[0]["thumbnail_url"] == "c1.jpg" and items[0]["added_at"] == "2024-02-03T00:00:00" and len(got) == 9


def test_closet_documents_are_made_once_per_name(spark, cat):
    from fixtures import lit_ts
    from tagrack.plans.checks import plan_text
    people = spark.createDataFrame([(1, "ann"), (2, "bob")], "site_user_id long, username string")
    closets = spark.createDataFrame([(7, 1, "Work")], "closet_id long, site_user_id long, name string").withColumn(
        "created_at", lit_ts("2024-01-02 03:04:05"))
    entries = spark.createDataFrame([(7, 1), (7, 3)], "closet_id long, item_id long").withColumn("added_at", lit_ts("2024-02-03 00:00:00"))
    full = cat.with_(site_user=people, closet=closets, closet_item=entries)
    asked = spark.createDataFrame([(1, "ann"), (4, "ann"), (4, "ann"), (5, "bob"), (5, "bob"), (6, None), (None, "ann")],
                                  "request_id long, username string")
    df = documents.closet_documents(asked, full, block=2)
    got = sorted(((r["request_id"] or 0, [i["base_item_name"] for i in d["items"]] if "items" in (d := json.loads(r["doc"])) else d)
                  for r in df.collect()), key=lambda x: x[0])
    once, twice = ["Coat", "Hat"], ["Coat", "Coat", "Hat", "Hat"]
    assert got == [(0, once), (1, once), (4, twice), (5, []), (5, []), (6, {"error": "unknown_user"})]
    lists = [x for x in plan_text(df, "simple").splitlines() if "collect_list" in x]
    assert lists and not any("keys=[request_id" in x for x in lists), lists
