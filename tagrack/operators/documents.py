"""JSON documents at the edge, shaped like the reference's API results.

The operators return flat, verifiable rows; these functions nest them per
request with ``collect_list(struct)`` + ``to_json``. Every list nested here is
bounded per request (one page, one item's images and sizes, k related items,
5 names per kind), so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..plans.materialize import materialize
from . import browse, detail, related, search, users


def _ordered(col_order: str, *fields: str):
    """Ordered array of structs (fields) by ``col_order``, order key dropped."""
    s = F.struct(F.col(col_order).alias("_o"), *[F.col(f) for f in fields])
    return F.transform(F.array_sort(F.collect_list(s)),
                       lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def browse_documents(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """(request_id, doc): {"total_pages": n, "items": [{brand_name, item_name,
    description, thumbnail_url}, ...]} in position order ([] when empty)."""
    page = browse.browse_page(requests, catalog)
    items = page.groupBy("request_id").agg(
        _ordered("position", "brand_name", "item_name", "description", "thumbnail_url").alias("items"))
    totals = browse.browse_totals(requests, catalog)
    empty = F.array().cast("array<struct<brand_name:string,item_name:string,"
                           "description:string,thumbnail_url:string>>")
    doc = F.struct(F.col("total_pages"), F.coalesce("items", empty).alias("items"))
    return totals.join(items, "request_id", "left").select("request_id", F.to_json(doc).alias("doc"))


def search_documents(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """(query_id, doc): {"tags": [...], "brands": [...], "items": [...]} names
    in rank order; every query gets a document (lists may be empty)."""
    hits = search.search_names(queries, catalog)
    per_kind = hits.groupBy("query_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "name")))),
                    lambda x: x["name"]).alias(k) for k in ("tags", "brands", "items")])
    empty = F.array().cast("array<string>")
    doc = F.struct(*[F.coalesce(k, empty).alias(k) for k in ("tags", "brands", "items")])
    return (queries.select("query_id").join(per_kind, "query_id", "left")
            .select("query_id", F.to_json(doc).alias("doc")))


def index_documents(brand: DataFrame, block: int = 1_000) -> DataFrame:
    """(initial, block, doc): the A-Z index as {"<initial>": [names]}, cut into
    documents of at most ``block`` names by their rank in the letter, so a
    crowded letter is many rows and no list grows with it."""
    ranked = search.brand_index(brand).withColumn("block", F.floor((F.col("rank") - 1) / block).cast("long"))
    names = ranked.groupBy("initial", "block").agg(_ordered("rank", "name").alias("n"))
    entry = F.map_from_entries(F.array(F.struct("initial", F.transform("n", lambda x: x["name"]))))
    return names.select("initial", "block", F.to_json(entry).alias("doc"))


def closet_documents(requests: DataFrame, catalog: Catalog, block: int = 1_000) -> DataFrame:
    """(request_id, closet_rank, block, doc) of the asked users' closets:
    {"closet_id", "name", "created_at", "items": [{base_item_name, brand_name,
    thumbnail_url, added_at}, ...]} with at most ``block`` items in a document;
    closets in order of their names. A user without closets has one
    row with [], an unknown one {"error": "unknown_user"}; both without a rank.

    Documents are made once per asked name; requests join them last, so what is
    shuffled grows with closets and requests, not with their product."""
    named = requests.filter(F.col("username").isNotNull())
    names = named.select("username").distinct().withColumn("request_id", F.col("username"))
    rows = users.closets_by_name(names, catalog.site_user, catalog.closet, catalog.closet_item, catalog)
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    rows = rows.withColumns({"block": F.coalesce(F.floor((F.col("item_rank") - 1) / block), F.lit(0)).cast("long"),
                             "base_item_name": F.col("item_name"), "added": at("added_at"), "created": at("created_at")})
    item = F.when(F.col("item_rank").isNotNull(), F.struct(
        F.col("item_rank").alias("_o"), "base_item_name", "brand_name", "thumbnail_url", F.col("added").alias("added_at")))
    lists = rows.groupBy("username", "closet_rank", "closet_id", "closet_name", "created", "block").agg(
        F.array_sort(F.collect_list(item)).alias("l"),  # at most ``block`` items
        F.min("status").alias("status"), F.count(F.lit(1)).cast("int").alias("c"))
    # a request that comes n times lists every item n times, and has n rows where there is no closet
    asked = named.groupBy("request_id", "username").agg(F.count(F.lit(1)).cast("int").alias("n"))
    lists = lists.join(asked.select("username", "n").distinct(), "username")
    l = F.when(F.col("n") == 1, F.col("l")).otherwise(F.flatten(F.transform("l", lambda x: F.array_repeat(x, F.col("n")))))
    doc = F.struct("closet_id", F.col("closet_name").alias("name"), F.col("created").alias("created_at"), F.transform(l, lambda x: F.struct(
        x["base_item_name"].alias("base_item_name"), x["brand_name"].alias("brand_name"), x["thumbnail_url"].alias("thumbnail_url"),
        x["added_at"].alias("added_at"))).alias("items"))
    error = lambda status: F.to_json(F.struct(status.alias("error")))
    found = F.col("closet_id").isNotNull()
    text = F.when(found, F.to_json(doc)).when(F.col("status") == "no_closets", F.lit("[]")).otherwise(error(F.col("status")))
    copies = F.when(found, F.lit(1)).otherwise(F.col("n") * F.col("c"))
    docs = lists.select("username", "n", "closet_rank", "block", F.explode(F.array_repeat(text, copies)).alias("doc"))
    return asked.join(docs, ["username", "n"]).select("request_id", "closet_rank", "block", "doc").unionByName(
        requests.filter(F.col("username").isNull()).select("request_id", F.lit(None).cast("long").alias("closet_rank"),
                                                           F.lit(0).cast("long").alias("block"), error(F.lit("unknown_user")).alias("doc")))


def detail_documents(requests: DataFrame, catalog: Catalog, stock: DataFrame) -> DataFrame:
    """(request_id, doc) like the reference's detail result: item_name,
    brand_name, description, image_urls, rating, item_specific_details
    [{size, in_stock}] and more_like {similar_items, more_from_brand}; error
    requests get {"error": status}."""
    res = materialize(detail.resolve_items(requests, catalog))
    ok = res.filter(F.col("status").isin("ok", "ambiguous"))
    wanted = ok.select("base_item_id").distinct()
    imgs = (catalog.base_item_image.join(wanted, "base_item_id", "left_semi")
            .join(catalog.image, "image_id").groupBy("base_item_id")
            .agg(_ordered("image_id", "url").alias("_imgs")))
    sizes = (detail.size_availability(catalog.sku.join(wanted, "base_item_id", "left_semi"), stock)
             .withColumnRenamed("basic_size", "size").groupBy("base_item_id")
             .agg(_ordered("relative_order", "size", "in_stock").alias("item_specific_details")))
    seeds = ok.select("request_id", "base_item_name", "brand_name", F.lit(4).alias("k"))
    cols = ("item_name", "brand_name", "thumbnail_url")
    known = ok.select("request_id", F.col("base_item_id").alias("seed_id"), F.lit(4).alias("k"))
    sim = related.similar_items(seeds, catalog, 4, resolved=known).groupBy("request_id").agg(
        _ordered("rank", *cols).alias("similar_items"))
    mfb = related.more_from_brand(seeds, catalog, 4).groupBy("request_id").agg(
        _ordered("rank", *cols).alias("more_from_brand"))
    item = catalog.base_item.select("base_item_id", "description", "rating")
    empty_items = F.array().cast("array<struct<item_name:string,brand_name:string,thumbnail_url:string>>")
    body = (ok.join(item, "base_item_id").join(imgs, "base_item_id", "left")
            .join(sizes, "base_item_id", "left").join(sim, "request_id", "left")
            .join(mfb, "request_id", "left"))
    doc = F.struct(
        F.col("base_item_name").alias("item_name"), "brand_name", "description",
        F.coalesce(F.transform("_imgs", lambda x: x["url"]), F.array().cast("array<string>")).alias("image_urls"),
        "rating",
        F.coalesce("item_specific_details",
                   F.array().cast("array<struct<size:string,in_stock:boolean>>")).alias("item_specific_details"),
        F.struct(F.coalesce("similar_items", empty_items).alias("similar_items"),
                 F.coalesce("more_from_brand", empty_items).alias("more_from_brand")).alias("more_like"))
    good = body.select("request_id", F.to_json(doc).alias("doc"))
    bad = res.filter(~F.col("status").isin("ok", "ambiguous")).select(
        "request_id", F.to_json(F.struct(F.col("status").alias("error"))).alias("doc"))
    return good.unionByName(bad)
