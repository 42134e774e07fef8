"""Shape the driver's TPC-H-like tables into the shop's catalogue (FIXTURES.md §3).

Every view is a lazy DataFrame over the Parquet scan, so a query that needs
two columns of ``part`` reads two columns. The same views are written as SQL
CTEs for the DuckDB oracle in ``tagrack.plans.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..functions.text import name_key
from ..model import Catalog
from ..plans.materialize import materialize
from .requests import DRAFTS_FROM
from .tables import Tables


def _word(c: str, n: int):
    return F.split_part(F.col(c), F.lit(" "), F.lit(n))


class Binding:
    """Lazily built catalogue views over one folder of driver tables.

    One instance serves one query: views that are written once (the tag
    dimension) are shared inside it and never outlive it, so replaced files
    are always read anew.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Binding":
        return cls(spark, sf_dir)

    # -- catalogue ---------------------------------------------------------
    @cached_property
    def brand(self) -> DataFrame:
        part = self.t.part
        from_part = (part.select("p_brand").distinct()
                     .select(F.substring("p_brand", 7, 1 << 20).cast("long").alias("brand_id"),
                             F.col("p_brand").alias("name")))
        docs = self.t.documents.select(
            "doc_id",
            F.split_part(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")),
                         F.lit(" "), F.lit(1)).alias("tok"))
        from_docs = (docs.filter(F.col("tok") != "")
                     .groupBy(F.lower("tok").alias("_k"))
                     .agg(F.min("doc_id").alias("_d"), F.min_by("tok", "doc_id").alias("name"))
                     .select((F.lit(100000) + F.col("_d")).cast("long").alias("brand_id"), "name"))
        return (from_part.unionByName(from_docs)
                .withColumn("name_key", name_key("name")))

    @cached_property
    def base_item(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.t.part.select(
            k.alias("base_item_id"),
            F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
            F.concat(F.col("p_type"), F.lit(" size "), F.col("p_size").cast("string")).alias("description"),
            F.when(k % 97 == 0, F.lit(None)).otherwise(
                F.substring("p_brand", 7, 1 << 20).cast("long")).alias("brand_id"),
            F.when(k % 10 == 0, F.lit(None)).otherwise(k).alias("thumbnail_image_id"),
            F.when(k % 53 == 0, F.lit(None)).otherwise(
                ((k % 51).cast("decimal(4,1)") / 10).cast("decimal(2,1)")).alias("rating"),
        ).withColumn("name_key", name_key("name"))

    @cached_property
    def image(self) -> DataFrame:
        return self.t.part.select(
            F.col("p_partkey").alias("image_id"),
            F.concat(F.lit("img-"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("url"))

    @cached_property
    def base_item_image(self) -> DataFrame:
        k = F.col("p_partkey")
        part = self.t.part.select("p_partkey")
        a = part.filter(k % 7 != 0).select(k.alias("base_item_id"), k.alias("image_id"))
        b = part.filter(k % 7 > 1).select(k.alias("base_item_id"), (k - 1).alias("image_id"))
        return a.unionByName(b)

    @cached_property
    def tag_name(self) -> DataFrame:
        part = self.t.part.select("p_partkey", "p_name", "p_type")
        pk = F.col("p_partkey").alias("base_item_id")
        return (part.select(pk, _word("p_name", 1).alias("name"))
                .unionByName(part.select(pk, _word("p_name", 2).alias("name")))
                .unionByName(part.select(pk, F.lower("p_type").alias("name")))
                .distinct())

    @cached_property
    def tag(self) -> DataFrame:
        # tag_id = rank of the name in code-point order (sort-based numbering,
        # no single-task window over the vocabulary).
        names = self.tag_name.select("name").distinct()
        ranked = positions(names, [], ["name"], pos_col="tag_id")
        # a small dimension read by many branches: written once
        return materialize(ranked.select(F.col("tag_id").cast("int"), "name")
                           .withColumn("name_key", name_key("name")))

    @cached_property
    def tag_item(self) -> DataFrame:
        return (self.tag_name.join(self.tag.select("tag_id", "name"), "name")
                .select("tag_id", "base_item_id"))

    # -- inventory ---------------------------------------------------------
    @cached_property
    def sku(self) -> DataFrame:
        ln = F.col("l_linenumber")
        size = F.when(ln == 1, "XS").when(ln == 2, "S").when(ln == 3, "M") \
            .when(ln == 4, "L").when(ln == 5, "XL").when(ln == 6, "XXL")
        return self.t.lineitem.select(
            (F.col("l_partkey") * 10 + ln).alias("item_id"),
            F.col("l_partkey").alias("base_item_id"),
            size.alias("basic_size")).distinct()

    @cached_property
    def stock_event(self) -> DataFrame:
        ev = (F.when(F.col("l_returnflag") == "N", "ship-in")
              .when(F.col("l_returnflag") == "R", "audit")
              .when(F.col("l_linestatus") == "F", "ship-out")
              .otherwise("scrap"))
        return self.t.lineitem.select(
            (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item_id"),
            ev.alias("transaction_event"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("l_shipdate").alias("transaction_date"),
            "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")

    # -- users ---------------------------------------------------------------
    @cached_property
    def site_user(self) -> DataFrame:
        c = self.t.customer
        return c.select(
            F.col("c_custkey").alias("site_user_id"),
            F.lit("Customer").alias("first_name"),
            F.substring("c_name", 10, 1 << 20).alias("last_name"),
            F.col("c_name").alias("username"),
            F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")),
                     F.lit("@example.com")).alias("email"),
            (F.col("c_mktsegment") == "MACHINERY").alias("is_staff"),
            (F.col("c_custkey") % 500 == 0).alias("is_admin"))

    @cached_property
    def closet(self) -> DataFrame:
        return (self.t.orders.groupBy("o_custkey", "o_orderpriority")
                .agg(F.min("o_orderkey").alias("closet_id"), F.min("o_orderdate").alias("created_at"))
                .select("closet_id", F.col("o_custkey").alias("site_user_id"),
                        F.col("o_orderpriority").alias("name"), "created_at"))

    @cached_property
    def closet_item(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_partkey", "l_shipdate")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
        c = self.closet.select("closet_id", F.col("site_user_id").alias("o_custkey"),
                               F.col("name").alias("o_orderpriority"))
        # each order finds its closet first, so the lines move by order only
        of = o.join(c, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "closet_id")
        return (li.join(of, li.l_orderkey == of.o_orderkey)
                .groupBy("closet_id", F.col("l_partkey").alias("item_id"))
                .agg(F.min("l_shipdate").alias("added_at")))

    @cached_property
    def session_open(self) -> DataFrame:
        e = self.t.events
        return e.filter(F.col("event_type") == "signup").select(
            F.col("event_id").alias("session_id"),
            F.col("user_id").alias("site_user_id"),
            F.concat(F.lit("tok-"), F.col("event_id").cast("string")).alias("session_token"),
            F.col("ts").alias("created_at"))

    @cached_property
    def search_log(self) -> DataFrame:
        e = self.t.events
        return e.select("event_id", "user_id", "ts",
                        F.concat(F.col("event_type"), F.lit("-"),
                                 F.col("event_id").cast("string")).alias("query"))

    # -- announced items ---------------------------------------------------
    def with_drafts(self) -> Catalog:
        """The catalogue and one announced item per supplier: with the image, tags
        and closets of its number, every second one with an (empty) SKU."""
        s = self.t.supplier.select(F.col("s_suppkey").cast("long").alias("n"), "s_name")
        draft = (F.lit(DRAFTS_FROM) + F.col("n"))
        items = s.select(draft.alias("base_item_id"), F.concat(F.lit("Announced by "), F.col("s_name")).alias("name"),
                         F.lit("").alias("description"), F.lit(None).cast("long").alias("brand_id"),
                         F.lit(None).cast("long").alias("thumbnail_image_id"), F.lit(None).cast("decimal(2,1)").alias("rating"))
        of = lambda rows, col: rows.join(s.select("n"), F.col(col) == F.col("n"))
        return Catalog(
            brand=self.brand, image=self.image,
            base_item=lambda: self.base_item.unionByName(items.withColumn("name_key", name_key("name"))),
            base_item_image=lambda: self.base_item_image.unionByName(of(self.image, "image_id").select(draft.alias("base_item_id"), "image_id")),
            tag=lambda: self.tag,
            tag_item=lambda: self.tag_item.unionByName(of(self.tag_item, "base_item_id").select("tag_id", draft.alias("base_item_id"))),
            sku=lambda: self.sku.unionByName(s.where("n % 2 = 0").select(
                (draft * 10).alias("item_id"), draft.alias("base_item_id"), F.lit("M").alias("basic_size"))),
            site_user=self.site_user, closet=lambda: self.closet,
            closet_item=lambda: self.closet_item.unionByName(of(self.closet, "site_user_id").select(
                "closet_id", draft.alias("item_id"), F.col("created_at").alias("added_at"))))

    def catalog(self) -> Catalog:
        """Every view as a table that is built when it is first read."""
        views = ("brand", "tag", "image", "base_item", "base_item_image", "tag_item", "sku", "site_user", "closet", "closet_item")
        return Catalog(**{name: (lambda name=name: getattr(self, name)) for name in views})
