"""Item detail and its parts: brand inference, id resolution, images, sizes.

Requests are ``(request_id, base_item_name, brand_name)``; brand may be NULL.
Each part is aggregated on its own key before it meets the requests, so no
side multiplies another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import spread
from ..functions.text import name_key
from ..model import DEFAULT_RELATED_K, Catalog, seed_sizes
from ..plans.materialize import materialize
from . import related
from .stock import closing_levels


def _keyed_items(catalog: Catalog) -> DataFrame:
    """Items that have a brand: (base_item_id, name_key, brand_key, brand_name)."""
    return catalog.base_item.select("base_item_id", "name_key", "brand_id").join(
        catalog.brand.select("brand_id", F.col("name_key").alias("brand_key"),
                             F.col("name").alias("brand_name")), "brand_id")


def infer_brand(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """(request_id, brand_name): the given brand, else the brand of the
    first (smallest id) branded item with that name; NULL if none."""
    r = requests.withColumn("name_key", name_key("base_item_name"))
    asked = r.select("name_key").distinct()          # aggregate only requested names
    first_brand = (_keyed_items(catalog).join(asked, "name_key", "left_semi").groupBy("name_key")
                   .agg(F.min_by("brand_name", "base_item_id").alias("_inferred")))
    return (r.join(spread(first_brand), "name_key", "left")
            .select("request_id", F.coalesce("brand_name", "_inferred").alias("brand_name")))


def resolve_items(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """(request_id, base_item_id, status) with status ok, ambiguous
    (several items; smallest id), missing, no_brand or missing_name."""
    brands = infer_brand(requests, catalog)
    r = (requests.select("request_id", "base_item_name").join(spread(brands), "request_id")
         .select("request_id", "base_item_name", "brand_name",
                 name_key("base_item_name").alias("name_key"),
                 name_key("brand_name").alias("brand_key")))
    asked = r.select("name_key", "brand_key").distinct()   # aggregate only requested keys
    per_key = (_keyed_items(catalog).join(asked, ["name_key", "brand_key"], "left_semi")
               .groupBy("name_key", "brand_key")
               .agg(F.min("base_item_id").alias("base_item_id"), F.count(F.lit(1)).alias("_n")))
    x = r.join(spread(per_key), ["name_key", "brand_key"], "left")
    status = (F.when(F.col("base_item_name").isNull(), "missing_name")
              .when(F.col("brand_name").isNull(), "no_brand")
              .when(F.col("base_item_id").isNull(), "missing")
              .when(F.col("_n") > 1, "ambiguous").otherwise("ok"))
    return x.select("request_id", "base_item_name", "brand_name",
                    F.when(F.col("base_item_name").isNotNull() & F.col("brand_name").isNotNull(),
                           F.col("base_item_id")).alias("base_item_id"),
                    status.alias("status"))


def item_images(catalog: Catalog, items: DataFrame | None = None) -> DataFrame:
    """(base_item_id, n_images, image_urls) for every item (or only those
    in ``items``); URLs in image_id order joined by ',' ('' when none)."""
    links = catalog.base_item_image
    base = catalog.base_item.select("base_item_id")
    if items is not None:
        wanted = items.select("base_item_id").distinct()
        links = links.join(spread(wanted), "base_item_id", "left_semi")
        base = base.join(spread(wanted), "base_item_id", "left_semi")
    imgs = spread(links).join(spread(catalog.image), "image_id")
    per_item = imgs.groupBy("base_item_id").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "url"))),
                                 lambda s: s["url"]), ",").alias("image_urls"))
    return (base.join(spread(per_item), "base_item_id", "left")
            .select("base_item_id", F.coalesce("n_images", F.lit(0)).cast("long").alias("n_images"),
                    F.coalesce("image_urls", F.lit("")).alias("image_urls")))


def size_availability(sku: DataFrame, stock: DataFrame) -> DataFrame:
    """(base_item_id, basic_size, relative_order, in_stock) per SKU with
    a known size; SKUs without stock rows are not in stock."""
    sizes = seed_sizes(sku.sparkSession)  # 7 fixed rows: bounded broadcast
    s = sku.join(F.broadcast(sizes.select(F.col("size").alias("_sk"), "relative_order")),
                 F.upper(sku.basic_size) == F.col("_sk")).drop("_sk")
    return (s.join(stock, "item_id", "left")
            .select("base_item_id", "basic_size", "relative_order",
                    (F.coalesce("stock_quantity", F.lit(0)) > 0).alias("in_stock")))


def _listing(rows: DataFrame, key: str, order: str, text) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda s: s["t"]), "|")
        .alias("_l"))


def item_detail(requests: DataFrame, catalog: Catalog, stock: DataFrame | None = None,
                events: DataFrame | None = None, order: list[str] | None = None,
                index: related.RelatedIndex | None = None) -> DataFrame:
    """U16: one row per request with item_name (as requested), brand_name,
    description, rating, image_urls, sizes ('XS:true|S:false', size order),
    similar and more_from_brand ('name~brand~thumbnail' by rank, k=4) and a status; fields stay
    NULL on error rows (missing_name, no_brand, missing).

    Stock comes either as levels (``stock``) or as raw ``events`` with their
    ``order``; then only the requested items' SKUs are summed (a SKU's stock
    depends on its own events alone). ``index`` is a kept index of related items."""
    res = materialize(resolve_items(requests, catalog))
    ok = res.filter(F.col("status").isin("ok", "ambiguous"))
    wanted = ok.select("base_item_id").distinct()   # only requested items are aggregated
    bi = catalog.base_item.select("base_item_id", "description", "rating")
    imgs = item_images(catalog, wanted).select("base_item_id", "image_urls")
    skus = catalog.sku.join(wanted, "base_item_id", "left_semi")
    if stock is None:
        mine = events.join(skus.select("item_id"), "item_id", "left_semi")
        stock = closing_levels(mine, order)
    avail = size_availability(skus, stock)
    sizes = _listing(avail, "base_item_id", "relative_order",
                     F.concat("basic_size", F.lit(":"), F.col("in_stock").cast("string")))
    sizes = sizes.withColumnRenamed("_l", "sizes")
    seeds = ok.select("request_id", "base_item_name", "brand_name",
                      F.lit(DEFAULT_RELATED_K).alias("k"))
    card = F.concat_ws("~", "item_name", F.coalesce("brand_name", F.lit("")), F.coalesce("thumbnail_url", F.lit("")))
    known = ok.select("request_id", F.col("base_item_id").alias("seed_id"), F.lit(DEFAULT_RELATED_K).alias("k"))
    sim = _listing(related.similar_items(seeds, catalog, DEFAULT_RELATED_K, index=index, resolved=known), "request_id",
                   "rank", card).withColumnRenamed("_l", "similar")
    mfb = _listing(related.more_from_brand(seeds, catalog, DEFAULT_RELATED_K), "request_id",
                   "rank", card).withColumnRenamed("_l", "more_from_brand")
    body = (ok.select("request_id", "base_item_id").join(spread(bi), "base_item_id")
            .join(spread(imgs), "base_item_id")
            .join(spread(sizes), "base_item_id", "left")
            .join(spread(sim), "request_id", "left").join(spread(mfb), "request_id", "left")
            .select("request_id", "description", "rating", "image_urls",
                    F.coalesce("sizes", F.lit("")).alias("sizes"),
                    F.coalesce("similar", F.lit("")).alias("similar"),
                    F.coalesce("more_from_brand", F.lit("")).alias("more_from_brand")))
    return (res.join(spread(body), "request_id", "left")
            .select("request_id", "status", F.col("base_item_name").alias("item_name"), "brand_name",
                    "description", "rating", "image_urls", "sizes", "similar", "more_from_brand"))
