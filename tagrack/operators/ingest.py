"""Feed ingest as whole-table steps.

The reference crawls one page, then inserts tags, vendors, and per item a
base item, its images and tags, one SKU per size and an opening ``audit``.
Here every step is a join/anti-join over all documents at once; failures go
to a rejects table and the rest is kept, as the reference logs and goes on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..functions.text import name_key
from ..model import Catalog, size_rank
from ..plans.materialize import materialize

IMAGE_URL_FORMAT = "https://images.example.com/products/%s?profile=a"


# The tables whose rows an ingest numbers, with their id.
ID_COLUMNS = {"tag": "tag_id", "brand": "brand_id", "base_item": "base_item_id", "image": "image_id", "sku": "item_id"}


def max_id(df: DataFrame, col: str) -> int:
    return int(df.agg(F.max(col)).first()[0] or 0)


def feed_items(docs: DataFrame) -> DataFrame:
    """One row per result item: (page, pos, feed_item_id, title, vendor,
    rating_raw, thumbnail_image, images, sizes, tags)."""
    x = docs.select(F.col("doc.product_list.current_page").alias("page"),
                    F.posexplode("doc.product_list.result_items").alias("pos", "it"))
    return x.select("page", "pos", F.col("it.id").alias("feed_item_id"),
                    F.col("it.title").alias("title"), F.col("it.vendor").alias("vendor"),
                    F.coalesce("it.averageReviewRating", F.lit(0.0)).alias("rating_raw"),
                    F.col("it.thumbnail_image").alias("thumbnail_image"),
                    F.coalesce("it.images", F.array().cast("array<string>")).alias("images"),
                    F.coalesce("it.sizes", F.create_map().cast("map<string,bigint>")).alias("sizes"),
                    F.coalesce("it.tags", F.array().cast("array<int>")).alias("tags"))


def parse_feed(docs: DataFrame) -> DataFrame:
    """U21 (flat summary): (feed_item_id, page, title, vendor, rating_raw,
    n_images, n_sizes, n_tags)."""
    it = feed_items(docs)
    return it.select("feed_item_id", "page", "title", "vendor", "rating_raw",
                     F.size("images").alias("n_images"), F.size("sizes").alias("n_sizes"),
                     F.size("tags").alias("n_tags"))


def feed_tag_names(docs: DataFrame) -> DataFrame:
    """(page, ord, feed_tag_id, website_text) of every tag list entry."""
    x = docs.select(F.col("doc.product_list.current_page").alias("page"),
                    F.posexplode("doc.product_list.tag_list").alias("ord", "t"))
    return x.select("page", "ord", F.col("t.tag_id").alias("feed_tag_id"),
                    F.col("t.website_text").alias("website_text"))


def feed_vendor_names(docs: DataFrame) -> DataFrame:
    """(page, handle, name) of every vendor list entry."""
    x = docs.select(F.col("doc.product_list.current_page").alias("page"),
                    F.explode("doc.product_list.vendor_list").alias("handle", "name"))
    return x


def insert_if_absent(dim: DataFrame, id_col: str, names: DataFrame, order: list[str],
                     top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Add names not yet present (case-insensitive); the first spelling
    in ``order`` wins; conflicts keep the existing row. New ids continue the
    table in name_key order, from ``top`` (read from the table unless given).
    Returns (dimension with new rows, new rows)."""
    n = names.filter(F.col("name").isNotNull()).withColumn("name_key", name_key("name"))
    first = (n.groupBy("name_key")
             .agg(F.min_by("name", F.struct(*order)).alias("name")))
    new = first.join(dim.select("name_key"), "name_key", "left_anti")
    base = max_id(dim, id_col) if top is None else top
    numbered = positions(new, [], ["name_key"], pos_col="_p")
    new_rows = numbered.select((F.lit(base) + F.col("_p")).cast(dim.schema[id_col].dataType).alias(id_col), "name", "name_key")
    return dim.unionByName(new_rows.select(*dim.columns)), new_rows


def feed_item_tags(docs: DataFrame) -> DataFrame:
    """(page, pos, feed_item_id, tag_name): item tag ids mapped through the
    batch's tag lists; ids in no list are dropped; repeats in one item collapse.
    Items are told apart by place, since a feed may repeat an id."""
    names = (feed_tag_names(docs).groupBy("feed_tag_id")
             .agg(F.min_by("website_text", F.struct("page", "ord")).alias("tag_name")))
    it = feed_items(docs).select("page", "pos", "feed_item_id", F.explode("tags").alias("feed_tag_id"))
    return it.join(names, "feed_tag_id").select("page", "pos", "feed_item_id", "tag_name").distinct()


def _checked_rating(raw):
    r = raw.try_cast("decimal(2,1)")
    return r, (r.isNull() | (r < 0) | (r > 5))


def check_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted items with ``rating``, rejects): rating cast to NUMERIC(2,1)
    (half up) and checked 0..5, name required."""
    rating, bad_rating = _checked_rating(F.col("rating_raw"))
    x = items.withColumn("rating", rating).withColumn(
        "_code", F.when(F.col("title").isNull(), "missing_name").when(bad_rating, "bad_rating"))
    rejects = x.filter(F.col("_code").isNotNull()).select(
        F.lit("base_item").alias("stage"), "feed_item_id",
        F.col("rating_raw").cast("string").alias("detail"), F.col("_code").alias("code"))
    return x.filter(F.col("_code").isNull()).drop("_code"), rejects


def fingerprint() -> Column:
    """SHA-256 of what a feed says of an item, whatever page it stands on."""
    return F.sha2(F.to_json(F.struct("title", "vendor", "rating_raw", "thumbnail_image", "images",
                                     F.array_sort(F.map_entries("sizes")).alias("sizes"), F.array_sort("tags").alias("tags"))), 256)


def decide_items(accepted: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(accepted items with fingerprint, decision and known_id; rejects): of items
    that share a feed id the first in feed order counts, the others are rejected as
    ``repeated_id``. Against ``known`` (feed_item_id, base_item_id, fingerprint) an item
    is ``new``, the ``same`` as before, or ``changed``. Items without a feed id are new."""
    x = accepted.withColumn("fingerprint", fingerprint())
    first = x.groupBy("feed_item_id").agg(F.min(F.struct("page", "pos")).alias("_first")).filter(F.col("feed_item_id").isNotNull())
    x = x.join(first, "feed_item_id", "left")
    again = F.coalesce(F.struct("page", "pos") != F.col("_first"), F.lit(False))
    rejects = x.filter(again).select(F.lit("base_item").alias("stage"), "feed_item_id",
                                     F.concat_ws(":", F.col("page").cast("string"), F.col("pos").cast("string")).alias("detail"),
                                     F.lit("repeated_id").alias("code"))
    x = x.filter(~again).drop("_first")
    if known is None:
        return x.withColumns({"known_id": F.lit(None).cast("long"), "decision": F.lit("new")}), rejects
    had = known.select("feed_item_id", F.col("base_item_id").alias("known_id"), F.col("fingerprint").alias("_had"))
    x = x.join(had, "feed_item_id", "left")
    decision = (F.when(F.col("known_id").isNull(), "new").when(F.col("fingerprint") == F.col("_had"), "same").otherwise("changed"))
    return x.withColumn("decision", decision).drop("_had"), rejects


def number_items(accepted: DataFrame, top: int) -> DataFrame:
    """(page, pos, base_item_id): each accepted item gets a new id after ``top``
    in feed order (not idempotent, as in the reference). Only the places are sorted."""
    numbered = positions(accepted.select("page", "pos"), [], ["page", "pos"], pos_col="_p")
    return numbered.select("page", "pos", (F.lit(top) + F.col("_p")).cast("long").alias("base_item_id"))


def add_images(catalog: Catalog, accepted: DataFrame, top: int) -> DataFrame:
    """Thumbnails and image lists of accepted items, inserted if absent."""
    urls = (accepted.select(F.explode(F.array_union(
                F.when(F.col("thumbnail_image").isNull(), F.array().cast("array<string>"))
                .otherwise(F.array("thumbnail_image")), F.col("images"))).alias("url"))
            .distinct().join(catalog.image.select("url"), "url", "left_anti"))
    return (positions(urls, [], ["url"], pos_col="_p")
            .select((F.lit(top) + F.col("_p")).cast("long").alias("image_id"), "url"))


def add_base_items(accepted: DataFrame, numbered: DataFrame, brand: DataFrame, image: DataFrame) -> DataFrame:
    """The new base items with feed_item_id. Brand looked up by name (CI),
    NULL if unknown; ``brand`` and ``image`` hold the feed's own already."""
    brands = brand.select("brand_id", F.col("name_key").alias("_vk"))
    thumbs = image.select(F.col("url").alias("thumbnail_image"), F.col("image_id").alias("thumbnail_image_id"))
    return (accepted.withColumn("_vk", name_key("vendor")).join(numbered, ["page", "pos"])
            .join(brands, "_vk", "left").join(thumbs, "thumbnail_image", "left")
            .select("base_item_id", F.col("title").alias("name"), name_key("title").alias("name_key"),
                    F.lit("").alias("description"), "brand_id", "thumbnail_image_id",
                    "rating", "feed_item_id", "page", "pos"))


def check_skus(numbered: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes of new items in size order, rejects): unknown sizes and sizes of
    rejected items are rejected."""
    sizes = items.select("page", "pos", "feed_item_id", F.explode("sizes").alias("size", "count"))
    x = sizes.join(numbered, ["page", "pos"], "left").withColumn("relative_order", size_rank(F.col("size")))
    x = x.withColumn("_code", F.when(F.col("base_item_id").isNull(), "no_base_item")
                     .when(F.col("relative_order").isNull(), "unknown_size"))
    rejects = x.filter(F.col("_code").isNotNull()).select(
        F.lit("sku").alias("stage"), "feed_item_id", F.col("size").alias("detail"), F.col("_code").alias("code"))
    return x.filter(F.col("_code").isNull()).drop("_code", "page", "pos"), rejects


def add_skus(sized: DataFrame, top: int) -> DataFrame:
    """One SKU per (item, known size, case-insensitive). New item_ids
    continue after ``top`` in (base_item_id, size order)."""
    numbered = positions(sized, [], ["base_item_id", "relative_order"], pos_col="_p")
    return numbered.select((F.lit(top) + F.col("_p")).cast("long").alias("item_id"),
                           "base_item_id", F.col("size").alias("basic_size"), "feed_item_id", "count")


def opening_stock(skus: DataFrame) -> DataFrame:
    """An ``audit`` per new SKU with the feed's count; the SKUs are new, so
    the delta is the count."""
    return skus.select("item_id", F.lit("audit").alias("transaction_event"),
                       F.col("count").alias("quantity"), F.col("count").cast("long").alias("delta_quantity"))


class IngestResult:
    """The whole feed at once. Tags and vendors upserted, items added with
    images and tags, SKUs per size, opening audits; all failures in ``rejects``
    (stage, feed_item_id, detail, code), a document that is no JSON or holds no
    product list among them.

    Every step is built when it is first read and then kept, so who wants the
    new SKUs does not pay for images. The parsed documents and the numbered
    places are written once and read by the later steps. ``tops`` are the
    largest ids by table, where known; the others are read from the catalogue.

    With ``dedupe`` a feed id is ingested once: items are told apart by
    ``decide_items``, against ``known`` from earlier feeds. New items are added as
    without it; of a changed one the base item's fields are replaced and images and
    tags it did not have are attached (its SKUs and stock are the ledger's); the same
    item does nothing. ``decisions`` tells which was which and ``feed_refs`` is what
    the next feed has to know.
    """

    def __init__(self, catalog: Catalog, docs: DataFrame, tops: dict[str, int] | None = None, materialized: bool = False,
                 dedupe: bool = False, known: DataFrame | None = None):
        self.before, self._docs, self._tops, self._materialized = catalog, docs, dict(tops or {}), materialized
        self._dedupe, self._known = dedupe or known is not None, known

    def top(self, table: str) -> int:
        """The largest id of a table before the ingest."""
        if table not in self._tops:
            self._tops[table] = max_id(getattr(self.before, table), ID_COLUMNS[table])
        return self._tops[table]

    @cached_property
    def docs(self) -> DataFrame:
        return self._docs if self._materialized else materialize(self._docs)

    @cached_property
    def items(self) -> DataFrame:
        return feed_items(self.docs)

    @cached_property
    def _tags(self) -> tuple[DataFrame, DataFrame]:
        names = feed_tag_names(self.docs).select(F.col("website_text").alias("name"), "page", "ord")
        return insert_if_absent(self.before.tag, "tag_id", names, ["page", "ord"], self.top("tag"))

    @cached_property
    def _brands(self) -> tuple[DataFrame, DataFrame]:
        vendors = feed_vendor_names(self.docs).select("name", "page", "handle")
        return insert_if_absent(self.before.brand, "brand_id", vendors, ["page", "handle"], self.top("brand"))

    @property
    def new_tags(self) -> DataFrame:
        return self._tags[1]

    @property
    def new_brands(self) -> DataFrame:
        return self._brands[1]

    @cached_property
    def _checked(self) -> tuple[DataFrame, DataFrame]:
        accepted, rejects = check_items(self.items)
        if not self._dedupe:
            return accepted, rejects
        return self._decided.filter(F.col("decision") == "new").select(*accepted.columns), rejects.unionByName(self._repeated)

    @cached_property
    def _decisions(self) -> tuple[DataFrame, DataFrame]:
        decided, repeated = decide_items(check_items(self.items)[0], self._known)
        return materialize(decided), repeated

    @property
    def _decided(self) -> DataFrame:
        return self._decisions[0]

    @property
    def _repeated(self) -> DataFrame:
        return self._decisions[1]

    @cached_property
    def _placed(self) -> DataFrame:
        """(page, pos, feed_item_id, fingerprint, decision, base_item_id)."""
        new = self.numbered.withColumnRenamed("base_item_id", "_new")
        return self._decided.join(new, ["page", "pos"], "left").select(
            "page", "pos", "feed_item_id", "fingerprint", "decision", F.coalesce("_new", "known_id").alias("base_item_id"))

    @property
    def decisions(self) -> DataFrame:
        """(feed_item_id, decision, base_item_id) of every item that is not rejected."""
        return self._placed.select("feed_item_id", "decision", "base_item_id")

    @property
    def feed_refs(self) -> DataFrame:
        """(feed_item_id, base_item_id, fingerprint) after this feed."""
        now = self._placed.filter(F.col("feed_item_id").isNotNull()).select("feed_item_id", "base_item_id", "fingerprint")
        if self._known is None:
            return now
        return now.unionByName(self._known.select(*now.columns).join(now.select("feed_item_id"), "feed_item_id", "left_anti"))

    @cached_property
    def changed_base_items(self) -> DataFrame:
        """The base items that a changed feed item replaces, as they are now."""
        of = self._decided.filter(F.col("decision") == "changed")
        return add_base_items(of.drop("known_id", "decision", "fingerprint"), of.select("page", "pos", F.col("known_id").alias("base_item_id")),
                              self._brands[0], self._images)

    @cached_property
    def numbered(self) -> DataFrame:
        return number_items(self._checked[0], self.top("base_item"))

    @property
    def _linked(self) -> DataFrame:
        """(page, pos, base_item_id) of the items whose images and tags count."""
        if not self._dedupe:
            return self.numbered
        return self._placed.filter(F.col("decision") != "same").select("page", "pos", "base_item_id")

    def _missing(self, links: DataFrame, table: str) -> DataFrame:
        """``links`` that the table does not hold; only changed items can have some."""
        return links.join(getattr(self.before, table), links.columns, "left_anti") if self._known is not None else links

    @cached_property
    def new_images(self) -> DataFrame:
        named = self._decided.filter(F.col("decision") != "same") if self._dedupe else self._checked[0]
        return add_images(self.before, named, self.top("image"))

    @property
    def _images(self) -> DataFrame:
        return self.before.image.select("image_id", "url").unionByName(self.new_images)

    @cached_property
    def new_base_items(self) -> DataFrame:
        return add_base_items(self._checked[0], self.numbered, self._brands[0], self._images)

    @cached_property
    def new_item_images(self) -> DataFrame:
        urls = self.items.select("page", "pos", F.explode("images").alias("url")).join(self._linked, ["page", "pos"])
        return self._missing(urls.join(self._images, "url").select("base_item_id", "image_id").distinct(), "base_item_image")

    @cached_property
    def new_item_tags(self) -> DataFrame:
        tags = self._tags[0].select("tag_id", F.col("name_key").alias("_k"))
        links = (feed_item_tags(self.docs).join(self._linked, ["page", "pos"])
                 .join(tags, name_key("tag_name") == F.col("_k")).select("tag_id", "base_item_id").distinct())
        return self._missing(links, "tag_item")

    @cached_property
    def _sized(self) -> tuple[DataFrame, DataFrame]:
        items = self.items
        if self._dedupe:  # sizes of items that are no news are neither added nor rejected
            items = items.join(self._decided.filter(F.col("decision") != "new").select("page", "pos"), ["page", "pos"], "left_anti")
        return check_skus(self.numbered, items)

    @cached_property
    def new_skus(self) -> DataFrame:
        return add_skus(self._sized[0], self.top("sku"))

    @cached_property
    def opening_ledger(self) -> DataFrame:
        return opening_stock(self.new_skus)

    @cached_property
    def rejects(self) -> DataFrame:
        broken = self.docs.filter(F.col("doc.product_list").isNull()).select(
            F.lit("document").alias("stage"), F.lit(None).cast("string").alias("feed_item_id"),
            (F.col("raw") if "raw" in self.docs.columns else F.lit(None).cast("string")).alias("detail"),
            F.lit("bad_json").alias("code"))
        dropped_tags = (self.items.select("feed_item_id", F.explode("tags").alias("feed_tag_id"))
                        .join(feed_tag_names(self.docs).select("feed_tag_id").distinct(), "feed_tag_id", "left_anti")
                        .select(F.lit("tag").alias("stage"), "feed_item_id",
                                F.col("feed_tag_id").cast("string").alias("detail"),
                                F.lit("unknown_tag_id").alias("code")))
        return self._checked[1].unionByName(self._sized[1]).unionByName(dropped_tags).unionByName(broken)

    @cached_property
    def catalog(self) -> Catalog:
        """The catalogue after the ingest."""
        old = self.before
        item_cols = ["base_item_id", "name", "name_key", "description", "brand_id", "thumbnail_image_id", "rating"]
        items = old.base_item
        if self._known is not None:
            now = materialize(self.changed_base_items.select(*item_cols))
            kept = items.select("base_item_id", "description").join(now.drop("description"), "base_item_id")  # a feed has no description
            items = items.join(now.select("base_item_id"), "base_item_id", "left_anti").unionByName(kept.select(*item_cols), allowMissingColumns=True)
        return old.with_(
            tag=self._tags[0], brand=self._brands[0],
            base_item=items.unionByName(self.new_base_items.select(*item_cols), allowMissingColumns=True),
            image=old.image.unionByName(self.new_images, allowMissingColumns=True),
            base_item_image=old.base_item_image.unionByName(self.new_item_images),
            tag_item=old.tag_item.unionByName(self.new_item_tags),
            sku=old.sku.unionByName(self.new_skus.select("item_id", "base_item_id", "basic_size")))


def ingest_feed(catalog: Catalog, docs: DataFrame, tops: dict[str, int] | None = None, materialized: bool = False,
                dedupe: bool = False, known: DataFrame | None = None) -> IngestResult:
    """``materialized``: the documents are written already and need not be once more."""
    return IngestResult(catalog, docs, tops, materialized, dedupe, known)


def added_items(before: Catalog, after: Catalog, ledger: DataFrame) -> DataFrame:
    """One row (stage, feed_item_id, detail, code), shaped like the rejects, per
    item that an ingest added: name, brand, rating, thumbnail, and numbers of
    images, SKUs, opening stock and tags, joined by bars."""
    known = max_id(before.base_item, "base_item_id")
    new = after.base_item.filter(F.col("base_item_id") > known).select("base_item_id", "name", "brand_id", "thumbnail_image_id", "rating")

    def count(rows: DataFrame, n, name: str) -> DataFrame:
        return rows.filter(F.col("base_item_id") > known).groupBy("base_item_id").agg(n.alias(name))

    stocked = after.sku.filter(F.col("base_item_id") > known).join(ledger.select("item_id", "quantity"), "item_id")
    x = (new.join(after.brand.select("brand_id", F.col("name").alias("brand")), "brand_id", "left")
         .join(after.image.select(F.col("image_id").alias("thumbnail_image_id"), "url"), "thumbnail_image_id", "left")
         .join(count(after.base_item_image, F.count("*"), "images"), "base_item_id", "left")
         .join(stocked.groupBy("base_item_id").agg(F.count("*").alias("skus"), F.sum("quantity").alias("stock")), "base_item_id", "left")
         .join(count(after.tag_item, F.count("*"), "tags"), "base_item_id", "left"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
             ("name", "brand", "rating", "url", "images", "skus", "stock", "tags")]
    return x.select(F.lit("item").alias("stage"), F.lit(None).cast("string").alias("feed_item_id"),
                    F.concat_ws("|", *parts).alias("detail"), F.lit("added").alias("code"))


def feed_image_urls(docs: DataFrame, fmt: str = IMAGE_URL_FORMAT) -> DataFrame:
    """(url) -- one download URL per distinct image name in the feed."""
    return (feed_items(docs).select(F.explode("images").alias("img")).distinct()
            .select(F.format_string(fmt, F.col("img")).alias("url")))
