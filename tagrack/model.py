"""Data model: the catalogue as a bundle of DataFrames, plus seed dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the reference's seed rows) -----------------
# Sizes in their relative order XS=1 .. XXXL=7.
SIZES = ["XS", "S", "M", "L", "XL", "XXL", "XXXL"]
# Inventory event types.
EVENT_TYPES = ["audit", "ship-in", "ship-out", "scrap"]
# Colour seed rows (name, hex code); loaded but consumed by no query.
COLORS = [
    ("Gold", "#D4AF37"), ("Silver", "#C2C2C2"), ("White", "#FFFBF0"),
    ("Black", "#0B0B0B"), ("Red", "#8B0000"), ("Blue", "#0F52BA"),
    ("Green", "#046307"), ("Yellow", "#F7E7CE"), ("Purple", "#6A0DAD"),
    ("Pink", "#F2C1D1"), ("Brown", "#5C2F1F"), ("Gray", "#6E6E6E"),
]
# Letters of the brand index page, in page order.
INDEX_LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + ["#"]
# Default related-list length, search results per kind, session lifetime.
DEFAULT_RELATED_K = 4
SEARCH_RESULTS_PER_KIND = 5
DEFAULT_PAGE_SIZE_SQL = 24
DEFAULT_PAGE_SIZE_HTTP = 20
MAX_PAGE_SIZE_HTTP = 100
SESSION_LIFETIME = "INTERVAL 1 DAY"
DEFAULT_CLOSET = "Favorites"
# Email domain check of the user table.
EMAIL_REGEX = (r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9]"
               r"(?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
               r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$")
# --------------------------------------------------------------------------


def size_rank(size: Column) -> Column:
    """Generated ``relative_order`` of a size (case-insensitive); unknown -> NULL."""
    up = F.upper(size)
    expr = None
    for i, s in enumerate(SIZES, start=1):
        expr = (F.when(up == s, F.lit(i)) if expr is None
                else expr.when(up == s, F.lit(i)))
    return expr.otherwise(F.lit(None).cast("int"))


def seed_sizes(spark: SparkSession) -> DataFrame:
    """The 7-row size dimension with its computed order (bounded, broadcastable)."""
    df = spark.createDataFrame([(s,) for s in SIZES], "size string")
    return df.withColumn("relative_order", size_rank(F.col("size")))


def seed_event_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in EVENT_TYPES], "transaction_event string")


def seed_colors(spark: SparkSession) -> DataFrame:
    rows = [(i, n, h) for i, (n, h) in enumerate(COLORS, start=1)]
    return spark.createDataFrame(rows, "color_id int, name string, hex_code string")


def index_letters(spark: SparkSession) -> DataFrame:
    rows = [(i, s) for i, s in enumerate(INDEX_LETTERS)]
    return spark.createDataFrame(rows, "letter_order int, initial string")


class Catalog:
    """All tables of the shop as DataFrames (one logical database state).

    Column sets (``name_key`` = lower(name) stands in for CITEXT):
      brand(brand_id, name, name_key)
      tag(tag_id, name, name_key)
      image(image_id, url)
      base_item(base_item_id, name, name_key, description, brand_id,
                thumbnail_image_id, rating decimal(2,1))
      base_item_image(base_item_id, image_id)
      tag_item(tag_id, base_item_id)
      sku(item_id, base_item_id, basic_size)
      ledger(item_id, transaction_event, delta_quantity, seq...)  optional
      site_user(site_user_id, first_name, last_name, username, email, is_staff, is_admin)
      session(session_id, site_user_id, session_token, created_at, expires_at)
      closet(closet_id, site_user_id, name, created_at)
      closet_item(closet_id, item_id, added_at)

    A table may be given as a function without arguments: it is called when the
    table is first read, so an operator pays only for the tables it uses.
    """

    TABLES = ("brand", "tag", "image", "base_item", "base_item_image", "tag_item", "sku", "site_user", "session",
              "closet", "closet_item", "ledger")

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame] | None):
        unknown = set(tables) - set(self.TABLES)
        if unknown:
            raise TypeError(f"no such tables: {sorted(unknown)}")
        self._given = {name: t for name, t in tables.items() if t is not None}

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in Catalog.TABLES:
            raise AttributeError(name)
        table = self._given.get(name)
        if callable(table):
            table = self._given[name] = table()
        return table

    def with_(self, **changes) -> "Catalog":
        return Catalog(**{**self._given, **changes})

    def names(self) -> list[str]:
        """The tables that this catalogue has, in a fixed order."""
        return [name for name in self.TABLES if name in self._given]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.names()}


BROWSE_REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("items_per_page", T.IntegerType()),
    T.StructField("include_tags", T.ArrayType(T.StringType())),
])

SEED_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("base_item_name", T.StringType()),
    T.StructField("brand_name", T.StringType()),
    T.StructField("k", T.IntegerType()),
])
