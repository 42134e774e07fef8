import json
import os
import tempfile
from decimal import Decimal

import pytest

from fixtures import catalog, rows
from tagrack.operators import ingest
from tagrack.sources import feed


def doc(page, items, tags, vendors):
    return {"success": True, "product_list": {
        "pages": 1, "current_page": page, "page_items_total": len(items), "search_items_total": len(items),
        "vendor_list": vendors, "tag_list": tags, "result_items": items}}


def item(i, title, vendor, rating, thumb, images, sizes, tag_ids):
    return {"id": str(i), "title": title, "handle": title.lower(), "averageReviewRating": rating,
            "prduct_cost": 1.0, "retail": 2.0, "discount": 0, "sale_stock_discount": 0, "sale_price": 2.0,
            "newitem_discount": 0, "useitem_discount": 0, "vendor": vendor, "vendor_handle": "v",
            "thumbnail_image": thumb, "images": images, "sizes": sizes, "tags": tag_ids}


DOCS = [
    doc(1, [item(1, "Silk Dress", "ACME", 4.25, "old.jpg", ["a.jpg", "b.jpg", "a.jpg"], {"s": 2, "XXXXL": 1},
                 [7, 8, 99]),
            item(2, "Bad", "Acme", 5.5, "c.jpg", [], {"M": 1}, [7])],
        [{"tag_id": 7, "tag_name": "dress", "website_text": "DRESS"},
         {"tag_id": 8, "tag_name": "silk", "website_text": "Silk"}],
        {"acme": "Acme", "new": "Newco"}),
    doc(2, [item(3, "Tee", "Nobody", 0.0, None, ["a.jpg"], {}, [8])],
        [{"tag_id": 8, "tag_name": "silk", "website_text": "Silk"}], {"new": "NEWCO"}),
]


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark, brands=[(1, "Acme")], items=[(1, "Old", 1, None, 1.0)],
                   tags=[(1, "dress")], images=[(5, "old.jpg")],
                   skus=[(100, 1, "M")])


@pytest.fixture(scope="module")
def docs(spark):
    raw = spark.createDataFrame([(json.dumps(d),) for d in DOCS], "raw string")
    return feed.parse_documents(raw)


def test_parse_and_tags(spark, docs):
    got = rows(ingest.parse_feed(docs), "feed_item_id", "page", "n_images", "n_sizes", "n_tags")
    assert got == [("1", 1, 3, 2, 3), ("2", 1, 0, 1, 1), ("3", 2, 1, 0, 1)]
    assert rows(ingest.feed_item_tags(docs), "feed_item_id", "tag_name") == [("1", "DRESS"), ("1", "Silk"), ("2", "DRESS"), ("3", "Silk")]


def test_insert_if_absent_is_case_insensitive(spark, cat, docs):
    names = ingest.feed_tag_names(docs).selectExpr("website_text AS name", "page", "ord")
    dim, new = ingest.insert_if_absent(cat.tag, "tag_id", names, ["page", "ord"])
    assert rows(new, "tag_id", "name") == [(2, "Silk")]
    assert dim.count() == 2
    vend = ingest.feed_vendor_names(docs).select("name", "page", "handle")
    _b, newb = ingest.insert_if_absent(cat.brand, "brand_id", vend, ["page", "handle"])
    assert rows(newb, "brand_id", "name") == [(2, "Newco")]     # first spelling wins


def test_ingest_end_to_end(spark, cat, docs):
    r = ingest.ingest_feed(cat, docs)
    items = rows(r.new_base_items, "feed_item_id", "base_item_id", "brand_id", "thumbnail_image_id", "rating")
    assert items == [("1", 2, 1, 5, Decimal("4.3")), ("3", 3, None, None, Decimal("0.0"))]
    assert rows(r.new_images, "url") == [("a.jpg",), ("b.jpg",)]
    assert rows(r.new_item_images) == [(2, 6), (2, 7), (3, 6)]
    assert rows(r.new_item_tags) == [(1, 2), (2, 2), (2, 3)]
    assert rows(r.new_skus, "item_id", "base_item_id", "basic_size", "count") == [(101, 2, "s", 2)]
    assert rows(r.opening_ledger, "item_id", "delta_quantity") == [(101, 2)]
    assert rows(r.rejects, "stage", "feed_item_id", "detail", "code") == [
        ("base_item", "2", "5.5", "bad_rating"), ("sku", "1", "XXXXL", "unknown_size"),
        ("sku", "2", "M", "no_base_item"), ("tag", "1", "99", "unknown_tag_id")]
    again = ingest.ingest_feed(r.catalog, docs)       # not idempotent, as the reference
    assert rows(again.new_base_items, "base_item_id") == [(4,), (5,)]


def test_feed_files_and_urls(spark, docs):
    d = tempfile.mkdtemp(prefix="feed-")
    with open(os.path.join(d, "page.json"), "w") as f:
        for x in DOCS:
            f.write(json.dumps(x) + "\n")
    from_files = feed.read_feed(spark, d)
    assert rows(ingest.parse_feed(from_files)) == rows(ingest.parse_feed(docs))
    urls = rows(ingest.feed_image_urls(docs))
    assert urls == [("https://images.example.com/products/a.jpg?profile=a",),
                    ("https://images.example.com/products/b.jpg?profile=a",)]


def test_stream_batch_retry_is_idempotent(spark, cat, docs):
    from tagrack.session import scratch_path
    from tagrack.streaming import ingest as sing
    out = scratch_path(spark, "ingest-retry")
    write = sing.ingest_batches(cat, out)
    write(docs, 0)
    first = rows(sing.read_state(spark, cat, out)[0].base_item, "base_item_id", "name")
    write(docs, 0)        # the same micro-batch again, as after a lost executor
    again = rows(sing.read_state(spark, cat, out)[0].base_item, "base_item_id", "name")
    assert again == first and len(first) == 3
    write(docs, 1)        # the next batch continues the ids
    assert [r[0] for r in rows(sing.read_state(spark, cat, out)[0].base_item, "base_item_id")] == [1, 2, 3, 4, 5]


def test_marks_carry_the_largest_ids(spark, cat, docs):
    from tagrack.session import scratch_path
    from tagrack.streaming import ingest as sing
    out = scratch_path(spark, "ingest-tops")
    write = sing.ingest_batches(cat, out)
    assert sing.read_tops(spark, out, 0) == {}
    write(docs, 0)
    state = sing.read_state(spark, cat, out)[0]
    want = {t: state_max for t, c in ingest.ID_COLUMNS.items()
            if (state_max := getattr(state, t).agg({c: "max"}).first()[0]) is not None}
    tops = sing.read_tops(spark, out, 1)
    assert {t: tops[t] for t in want} == want
    assert sing.read_tops(spark, out, 0) == {}      # a retried batch sees earlier marks only
    write(docs.limit(0), 1)                         # a batch that adds nothing keeps them
    assert sing.read_tops(spark, out, 2) == tops


def test_readers_see_whole_batches_only(spark, cat, docs):
    from tagrack.session import scratch_path
    from tagrack.streaming import ingest as sing
    out = scratch_path(spark, "ingest-half")
    sing.ingest_batches(cat, out)(docs, 0)
    whole = rows(sing.read_state(spark, cat, out)[0].base_item, "base_item_id")
    spark.createDataFrame([(99, "x")], "base_item_id long, name string").write.parquet(f"{out}/base_item/batch=1")
    assert rows(sing.read_state(spark, cat, out)[0].base_item, "base_item_id") == whole


def test_steps_are_built_only_when_read(spark, cat, docs):
    r = ingest.ingest_feed(cat, docs)
    assert r.new_skus.count() == 1
    assert not {"new_images", "new_base_items", "_tags", "_brands"} & set(vars(r))


def test_feed_text_sink_and_source_roundtrip(spark, docs):
    from tagrack.session import scratch_path
    raw = spark.createDataFrame([(json.dumps(d),) for d in DOCS], "raw string")
    path = scratch_path(spark, "feed-files")
    feed.write_feed(raw, path)
    back = feed.parse_documents(feed.read_feed_text(spark, path))
    assert rows(ingest.parse_feed(back)) == rows(ingest.parse_feed(docs))


def test_repeated_feed_ids_are_items_of_their_own(spark, cat):
    twice = [doc(p, [item(9, f"Tee {p}", "Acme", 1.0, None, [], {"M": n}, [t])],
                 [{"tag_id": 7, "tag_name": "dress", "website_text": "DRESS"}, {"tag_id": 8, "tag_name": "silk", "website_text": "Silk"}], {})
             for p, n, t in ((1, 1, 7), (2, 3, 8))]
    raw = spark.createDataFrame([(json.dumps(d),) for d in twice], "raw string")
    r = ingest.ingest_feed(cat, feed.parse_documents(raw))
    assert rows(r.new_skus, "base_item_id", "basic_size", "count") == [(2, "M", 1), (3, "M", 3)]
    assert rows(r.new_item_tags) == [(1, 2), (2, 3)]
    assert rows(r.opening_ledger, "item_id", "delta_quantity") == [(101, 1), (102, 3)]


def test_broken_documents_are_rejected_with_their_text(spark, cat):
    raw = spark.createDataFrame([('{"success": tru',), (json.dumps(DOCS[1]),), ("{}",)], "raw string")
    r = ingest.ingest_feed(cat, feed.parse_documents(raw))
    assert rows(r.new_base_items, "feed_item_id") == [("3",)]
    assert rows(r.rejects.filter("stage = 'document'"), "detail", "code") == [('{"success": tru', "bad_json"), ("{}", "bad_json")]


def _again(docs_of):
    """The feed as it comes a second time: one item changed, one new, one repeated, one document broken."""
    import copy
    second = copy.deepcopy(docs_of)
    second[0]["product_list"]["result_items"][0].update(title="Silk Gown", vendor="Newco", images=["a.jpg", "z.jpg"], tags=[7])
    second[1]["product_list"]["result_items"] += [item(9, "Cap", "Acme", 2.0, None, [], {"M": 4}, [8]),
                                                  item(3, "Tee two", "Acme", 1.0, None, [], {}, [])]
    return second


def test_a_feed_that_comes_again_adds_nothing_twice(spark, cat):
    parse = lambda ds, *more: feed.parse_documents(spark.createDataFrame([(json.dumps(d),) for d in ds] + [(m,) for m in more], "raw string"))
    first = ingest.ingest_feed(cat, parse(DOCS), dedupe=True)
    refs = first.feed_refs
    assert rows(first.decisions, "feed_item_id", "decision", "base_item_id") == [("1", "new", 2), ("3", "new", 3)]
    plain = ingest.ingest_feed(cat, parse(DOCS))
    for table in ("base_item", "base_item_image", "tag_item", "sku", "image", "tag", "brand"):
        assert rows(getattr(first.catalog, table)) == rows(getattr(plain.catalog, table))

    same = ingest.ingest_feed(first.catalog, parse(DOCS), known=refs)
    assert rows(same.decisions, "feed_item_id", "decision", "base_item_id") == [("1", "same", 2), ("3", "same", 3)]
    for table in ("base_item", "base_item_image", "tag_item", "sku", "image", "tag", "brand"):
        assert rows(getattr(same.catalog, table)) == rows(getattr(first.catalog, table)), table
    assert same.opening_ledger.count() == 0 and rows(same.feed_refs) == rows(refs)

    again = ingest.ingest_feed(first.catalog, parse(_again(DOCS), json.dumps(DOCS[0])[:200]), known=refs)
    assert rows(again.decisions, "feed_item_id", "decision", "base_item_id") == [("1", "changed", 2), ("3", "same", 3), ("9", "new", 4)]
    assert {("3", "repeated_id"), (None, "bad_json"), ("2", "bad_rating")} <= set(rows(again.rejects, "feed_item_id", "code"))
    items = {r["base_item_id"]: r for r in again.catalog.base_item.collect()}
    assert len(items) == 4 and items[2]["name"] == "Silk Gown" and items[1]["name"] == "Old" and items[4]["name"] == "Cap"
    brands = {r["brand_id"]: r["name"] for r in again.catalog.brand.collect()}
    assert brands[items[2]["brand_id"]] == "Newco"
    urls = {r["image_id"]: r["url"] for r in again.catalog.image.collect()}
    assert {urls[r["image_id"]] for r in again.catalog.base_item_image.collect() if r["base_item_id"] == 2} == {"a.jpg", "b.jpg", "z.jpg"}
    links = rows(again.catalog.tag_item, "base_item_id", "tag_id")
    assert len(links) == len(set(links))
    assert rows(again.opening_ledger, "quantity") == [(4,)]


def test_stream_lookups_read_the_names_of_a_batch_only(spark, tmp_path):
    from tagrack.streaming import ingest as ing
    from pyspark.sql import functions as F

    from tagrack.plans.checks import plan_text
    reads = {}
    for size in (50, 5_000):
        out = str(tmp_path / f"out{size}")
        big = catalog(spark, brands=[(i, f"Brand {i}") for i in range(1, size)], items=[(1, "Old", 1, None, 1.0)],
                      tags=[(i, f"tag {i}") for i in range(1, size)], images=[(i, f"{i}.jpg") for i in range(1, size)], skus=[(100, 1, "M")])
        write = ing.ingest_batches(big, out)
        for n, d in enumerate(DOCS):
            write(feed.parse_documents(spark.createDataFrame([(json.dumps(d),)], "raw string")), n)
        keys = ing.batch_keys(feed.parse_documents(spark.createDataFrame([(json.dumps(DOCS[1]),)], "raw string")))
        found = {t: ing.lookup(spark, out, t, k, 1) for t, k in keys.items()}
        reads[size] = {t: len({r[0].split("division=")[1].split("/")[0] for r in f.select(F.input_file_name()).distinct().collect()})
                       for t, f in found.items()}
        assert all("PartitionFilters: [isnotnull(batch" in plan_text(f) or "division" in plan_text(f).split("PartitionFilters:")[1].split("\n")[0]
                   for f in found.values())
        assert rows(found["brand"].filter("name_key = 'newco'"), "name") == [("Newco",)]
        after, _ledger, _rejects = ing.read_state(spark, big, out)
        assert after.brand.filter("name = 'Newco'").count() == 1 and after.base_item.count() == 3
    # as many divisions as the batch has names, however many the catalogue holds
    assert all(reads[5_000][t] <= keys[t].distinct().count() for t in keys), reads
