"""Product feed documents: schema, file source/sink, and a builder from ``part``.

A feed document is one JSON object per page of products (FIXTURES.md §1).
Files hold one document per line and are read with an explicit schema (no
inference). The builder turns the driver's ``part`` table into such
documents with ``to_json`` so ingest runs on data that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Tables

TAG_ENTRY = T.StructType([
    T.StructField("tag_id", T.IntegerType()),
    T.StructField("tag_name", T.StringType()),
    T.StructField("website_text", T.StringType()),
])

FEED_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("handle", T.StringType()),
    T.StructField("averageReviewRating", T.DoubleType()),
    T.StructField("prduct_cost", T.DoubleType()),  # spelled so in the feed
    T.StructField("retail", T.DoubleType()),
    T.StructField("discount", T.DoubleType()),
    T.StructField("sale_stock_discount", T.DoubleType()),
    T.StructField("sale_price", T.DoubleType()),
    T.StructField("newitem_discount", T.DoubleType()),
    T.StructField("useitem_discount", T.DoubleType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("vendor_handle", T.StringType()),
    T.StructField("thumbnail_image", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("sizes", T.MapType(T.StringType(), T.LongType())),
    T.StructField("tags", T.ArrayType(T.IntegerType())),
])

FEED_SCHEMA = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("product_list", T.StructType([
        T.StructField("pages", T.IntegerType()),
        T.StructField("current_page", T.IntegerType()),
        T.StructField("page_items_total", T.IntegerType()),
        T.StructField("search_items_total", T.IntegerType()),
        T.StructField("vendor_list", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tag_list", T.ArrayType(TAG_ENTRY)),
        T.StructField("result_items", T.ArrayType(FEED_ITEM)),
    ])),
])

ITEMS_PER_PAGE = 48  # feed page size of the reference's crawler
# Tag ids of built documents: five size tags, an unknown one, and the catalogue's
# tags above both, so that no number of tags makes them meet.
SIZE_TAGS_FROM, UNKNOWN_TAG_ID, CATALOGUE_TAGS_FROM = 2_000, 9_999, 10_000


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed files (JSON lines) -> DataFrame(doc) with the fixed schema."""
    return spark.read.schema(FEED_SCHEMA).json(path).select(F.struct("*").alias("doc"))


def read_feed_text(spark: SparkSession, path: str) -> DataFrame:
    """Feed files as raw text, one document per row: DataFrame(raw)."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def write_feed(raw: DataFrame, path: str) -> None:
    raw.select("raw").write.mode("overwrite").text(path)


def parse_documents(raw: DataFrame) -> DataFrame:
    """DataFrame(raw string) -> DataFrame(doc struct, raw) via ``from_json``; a
    broken document has a doc without product list."""
    return raw.select(F.from_json("raw", FEED_SCHEMA).alias("doc"), "raw")


def _by_k(x, y):
    """Comparator on the ``_k`` field (items hold a map, so structs do not order)."""
    return F.when(x["_k"] < y["_k"], -1).when(x["_k"] > y["_k"], 1).otherwise(0)


def feed_from_part(t: Tables, tag: DataFrame) -> DataFrame:
    """DataFrame(page_id, raw): one JSON feed document per 48 parts.

    Item fields derive from the part row; the variations exercise every
    ingest rule (unknown vendor, brand in other case, new vendor, existing
    thumbnail URL, repeated image, unknown size, size in lower case, unknown
    tag id, ratings past 5 and on .25 steps).
    """
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    ks = k.cast("string")
    w1 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    w2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    names = tag.select("tag_id", "name")
    # the item's catalogue tags, as feed tag ids
    item_tags = (p.select("p_partkey", F.explode(F.array(w1, w2, F.lower("p_type"))).alias("name"))
                 .join(names, "name")
                 .groupBy("p_partkey").agg(F.array_sort(F.collect_set(F.col("tag_id") + CATALOGUE_TAGS_FROM)).alias("_t")))
    size_tag = (F.col("p_size") % 5 + SIZE_TAGS_FROM).cast("int")
    label = F.concat(F.lit("Label "), (k % 7).cast("string"))
    vendor = (F.when(k % 97 == 0, F.lit("Unknown Vendor")).when(k % 89 == 0, label)
              .when(k % 5 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")))
    a = F.concat(F.lit("feed-"), ks, F.lit("-a.jpg"))
    b = F.concat(F.lit("feed-"), ks, F.lit("-b.jpg"))
    old = F.concat(F.lit("img-"), ks, F.lit(".jpg"))
    images = (F.when(k % 6 == 0, F.array(a, b, a)).when(k % 5 == 0, F.array(a, old))
              .otherwise(F.array(a, b)))
    entry = lambda s, n: F.struct(F.lit(s).alias("key"), n.cast("long").alias("value"))
    none = F.lit(None).cast("struct<key:string,value:bigint>")
    sizes = F.map_from_entries(F.filter(F.array(
        entry("XS", F.col("p_size") % 3),
        entry("M", F.col("p_size") % 4),
        F.when(k % 2 == 0, entry("L", F.lit(1))).otherwise(none),
        F.when(k % 7 == 0, entry("s", F.lit(2))).otherwise(none),
        F.when(k % 11 == 0, entry("XXXXL", F.lit(1))).otherwise(none),
    ), lambda e: e.isNotNull()))
    tags = F.concat(F.coalesce("_t", F.array().cast("array<int>")), F.array(size_tag),
                    F.when(k % 13 == 0, F.array(F.lit(UNKNOWN_TAG_ID)))
                    .otherwise(F.array().cast("array<int>")))
    item = F.struct(
        ks.alias("id"),
        F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("handle"),
        ((k % 23) * F.lit(0.25)).cast("double").alias("averageReviewRating"),
        (F.col("p_retailprice") / 2).alias("prduct_cost"),
        F.col("p_retailprice").alias("retail"),
        F.lit(0.0).alias("discount"), F.lit(0.0).alias("sale_stock_discount"),
        F.col("p_retailprice").alias("sale_price"),
        F.lit(0.0).alias("newitem_discount"), F.lit(0.0).alias("useitem_discount"),
        vendor.alias("vendor"),
        F.lower("p_brand").alias("vendor_handle"),
        F.when(k % 4 == 0, F.concat(F.lit("feed-"), ks, F.lit("-t.jpg"))).otherwise(old)
         .alias("thumbnail_image"),
        images.alias("images"), sizes.alias("sizes"), tags.alias("tags"))
    tag_entries = F.concat(
        F.transform(F.coalesce("_t", F.array().cast("array<int>")),
                    lambda i: F.struct(i.alias("tag_id"))),
        F.array(F.struct(size_tag.alias("tag_id"))))
    vend = F.array(F.struct(F.lower("p_brand").alias("h"), F.col("p_brand").alias("v")))
    vend = F.when((k % 97 != 0) & (k % 89 == 0),
                  F.array_append(vend, F.struct(F.lower(label).alias("h"), label.alias("v")))).otherwise(vend)
    rows = (p.join(item_tags, "p_partkey", "left")
            .select(F.floor(k / ITEMS_PER_PAGE).alias("page_id"), k.alias("_k"), item.alias("item"),
                    tag_entries.alias("_te"), vend.alias("_v")))
    tag_text = names.select((F.col("tag_id") + CATALOGUE_TAGS_FROM).alias("tag_id"), F.col("name").alias("tag_name"))
    page_tags = (rows.select("page_id", F.explode("_te.tag_id").alias("tag_id")).distinct()
                 .join(tag_text, "tag_id", "left")
                 .select("page_id", F.struct(
                     F.col("tag_id").cast("int").alias("tag_id"),
                     F.coalesce("tag_name", F.concat(F.lit("size-"), (F.col("tag_id") - SIZE_TAGS_FROM).cast("string")))
                      .alias("tag_name"),
                     F.initcap(F.coalesce("tag_name", F.concat(F.lit("size-"),
                                                               (F.col("tag_id") - SIZE_TAGS_FROM).cast("string"))))
                      .alias("website_text")).alias("t"))
                 .groupBy("page_id").agg(F.array_sort(F.collect_list("t")).alias("tag_list")))
    vendors = (rows.select("page_id", F.explode("_v").alias("v")).distinct()
               .groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list("v"))).alias("vendor_list")))
    pages = (rows.groupBy("page_id")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "item")), _by_k),
                              lambda s: s["item"]).alias("result_items")))
    n_pages = p.agg(F.max(F.floor(k / ITEMS_PER_PAGE)) + 1, F.count(F.lit(1))).first()
    doc = F.struct(
        F.lit(True).alias("success"),
        F.struct(F.lit(int(n_pages[0] or 0)).alias("pages"),
                 (F.col("page_id") + 1).cast("int").alias("current_page"),
                 F.size("result_items").alias("page_items_total"),
                 F.lit(int(n_pages[1] or 0)).alias("search_items_total"),
                 "vendor_list", "tag_list", "result_items").alias("product_list"))
    return (pages.join(vendors, "page_id").join(page_tags, "page_id")
            .select("page_id", F.to_json(doc).alias("raw")))


def feed_again(raw: DataFrame) -> DataFrame:
    """DataFrame(page_id, raw): the feed as it comes a second time. Every tenth item
    has a new title, every page repeats its first item at the end, and every fifth
    document comes once more, cut off in the middle."""
    docs = raw.select("page_id", F.from_json("raw", FEED_SCHEMA).alias("d"))
    items = F.col("d.product_list.result_items")
    renamed = F.transform(items, lambda i: i.withField(
        "title", F.when(i["id"].cast("long") % 10 == 0, F.concat(i["title"], F.lit(" II"))).otherwise(i["title"])))
    doc = F.col("d").withField("product_list.result_items", F.concat(renamed, F.slice(renamed, 1, 1)))
    broken = raw.filter(F.col("page_id") % 5 == 0).select("page_id", F.expr("substring(raw, 1, length(raw) div 2)").alias("raw"))
    return docs.select("page_id", F.to_json(doc).alias("raw")).unionByName(broken)
