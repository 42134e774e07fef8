"""Tiny hand-written catalogues for edge-case tests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tagrack.functions.text import name_key
from tagrack.model import Catalog


def catalog(spark, brands, items, tags=(), item_tags=(), images=(), item_images=(), skus=()):
    """brands: [(id, name)]; items: [(id, name, brand_id, thumb_id, rating)];
    tags: [(id, name)]; item_tags: [(tag_id, item_id)]; images: [(id, url)];
    item_images: [(item_id, image_id)]; skus: [(sku_id, item_id, size)]."""
    brand = spark.createDataFrame(list(brands), "brand_id int, name string") \
        .withColumn("name_key", name_key("name"))
    rows = [(i, n, f"desc {i}", b, t, Decimal(str(r)) if r is not None else None)
            for i, n, b, t, r in items]
    base_item = spark.createDataFrame(
        rows, "base_item_id long, name string, description string, brand_id int, "
              "thumbnail_image_id long, rating decimal(2,1)").withColumn("name_key", name_key("name"))
    tag = spark.createDataFrame(list(tags), "tag_id int, name string").withColumn("name_key", name_key("name"))
    tag_item = spark.createDataFrame(list(item_tags), "tag_id int, base_item_id long")
    image = spark.createDataFrame(list(images), "image_id long, url string")
    bii = spark.createDataFrame(list(item_images), "base_item_id long, image_id long")
    sku = spark.createDataFrame(list(skus), "item_id long, base_item_id long, basic_size string")
    return Catalog(brand=brand, tag=tag, image=image, base_item=base_item, base_item_image=bii,
                   tag_item=tag_item, sku=sku)


def rows(df, *cols, order=None):
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t)) if order is None else out


def lit_ts(s):
    return F.lit(s).cast("timestamp_ntz")
