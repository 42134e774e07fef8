"""Related items: similar by shared tags, more from the brand, both lists.

Seeds are a DataFrame ``(request_id, base_item_name, brand_name, k)``; names
and brands compare case-insensitively. Ordering is by score (similar only),
then case-insensitive name, then name, then id (ties the reference leaves open).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import spread
from ..functions.ranking import top_k
from ..functions.text import name_key
from ..model import Catalog
from ..plans.materialize import materialize
from ..session import scratch_path
from ..sources.tables import read_parquet_if_present


def _k(c="k"):
    """``GREATEST(k, 0)`` with NULL -> 0 (GREATEST skips NULLs)."""
    return F.greatest(F.col(c), F.lit(0))


def max_k(seeds: DataFrame) -> int:
    """Largest list length asked for: one scalar aggregate, so per-group limits
    below can be literals (planned as partial ``WindowGroupLimit``)."""
    v = seeds.agg(F.max(_k())).first()[0]
    return int(v or 0)


def resolve_seeds(seeds: DataFrame, catalog: Catalog) -> DataFrame:
    """(request_id, seed_id, k): smallest base_item_id with that name and brand."""
    items = catalog.base_item.select("base_item_id", "name_key", "brand_id")
    brands = catalog.brand.select("brand_id", F.col("name_key").alias("brand_key"))
    keyed = spread(items.join(brands, "brand_id").select(
        "base_item_id", F.col("name_key").alias("seed_nk"), "brand_key"))
    s = seeds.select("request_id", _k().alias("k"),
                     name_key("base_item_name").alias("seed_nk"),
                     name_key("brand_name").alias("brand_key"))
    return (s.join(keyed, ["seed_nk", "brand_key"])
            .groupBy("request_id", "k").agg(F.min("base_item_id").alias("seed_id")))


def item_signatures(catalog: Catalog) -> DataFrame:
    """(base_item_id, sig): an item's sorted tag ids joined by ','.

    Items with equal tag sets score alike against any seed, so scoring works
    on distinct signatures and never on item pairs.
    """
    return (catalog.tag_item.groupBy("base_item_id")
            .agg(F.array_join(F.array_sort(F.collect_list("tag_id")), ",").alias("sig")))


def _display(rows: DataFrame, catalog: Catalog) -> DataFrame:
    bi = catalog.base_item.select("base_item_id", F.col("name").alias("item_name"),
                                  "brand_id", "thumbnail_image_id")
    br = catalog.brand.select("brand_id", F.col("name").alias("brand_name"))
    im = catalog.image.select(F.col("image_id").alias("thumbnail_image_id"),
                              F.col("url").alias("thumbnail_url"))
    return (spread(rows).join(spread(bi), "base_item_id").join(br, "brand_id", "left")
            .join(spread(im), "thumbnail_image_id", "left"))


# A tag held by more than this share of the distinct signatures is "hot" (see
# similar_items); with t tags on an item there are at most t / HOT_SHARE of them.
HOT_SHARE = 0.02


def _by_name() -> list:
    return [F.col("name_key").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("base_item_id").asc()]


class RelatedIndex:
    """What similar items need of the catalogue alone, written once and kept.

    Signatures of items, the tags of distinct signatures, the hot tags among them,
    per signature and per hot projection the first ``keep`` items by name. Requests
    read it and touch no other table but for the texts shown. Hotness looks at
    all signatures, so a changed catalogue gets a new index in a new folder.
    """

    TABLES = ("signatures", "tags", "hot", "by_signature", "projections", "by_projection")

    def __init__(self, spark: SparkSession, path: str):
        done = read_parquet_if_present(spark, f"{path}/done")
        if done is None:
            raise ValueError(f"no whole index in {path}")
        self.keep = done.first()["keep"]
        self.signatures, self.tags, self.hot, self.by_signature, self.projections, self.by_projection = (
            spark.read.parquet(f"{path}/{t}") for t in self.TABLES)

    @classmethod
    def build(cls, catalog: Catalog, keep: int, hot_share: float = HOT_SHARE, path: str | None = None) -> RelatedIndex:
        """Write the index for lists of up to ``keep - 1`` items."""
        spark = catalog.base_item.sparkSession
        path = path or scratch_path(spark, "related-index")

        def put(df: DataFrame, table: str) -> DataFrame:
            df.write.parquet(f"{path}/{table}")
            return spark.read.schema(df.schema).parquet(f"{path}/{table}")

        sigs = put(item_signatures(catalog), "signatures")
        tags = put(sigs.select("sig").distinct().select("sig", F.explode(F.split("sig", ",")).alias("tag")), "tags")
        n_sigs = tags.agg(F.count_distinct("sig")).first()[0]
        hot = put(tags.groupBy("tag").agg(F.count(F.lit(1)).alias("_df"))
                  .filter(F.col("_df") > hot_share * n_sigs).select("tag"), "hot")
        named = spread(sigs).join(spread(catalog.base_item.select("base_item_id", "name", "name_key")), "base_item_id")
        put(top_k(named, ["sig"], _by_name(), keep, rank_col="_r").drop("_r"), "by_signature")
        proj = put(tags.join(hot, "tag", "left_semi").groupBy("sig")
                   .agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("hp")), "projections")
        put(top_k(named.join(proj, "sig"), ["hp"], _by_name(), keep, rank_col="_r").drop("_r", "sig"), "by_projection")
        spark.range(1).select(F.lit(keep).alias("keep")).write.parquet(f"{path}/done")  # last: the index is whole
        return cls(spark, path)


def similar_items(seeds: DataFrame, catalog: Catalog, kmax: int | None = None, hot_share: float = HOT_SHARE,
                  index: RelatedIndex | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """Top-k items sharing the most tags with each seed (seed excluded).

    Output (request_id, rank, item_name, brand_name, thumbnail_url, shared_tag_count).

    ``index`` is a kept ``RelatedIndex`` of the catalogue (built for the call
    without one); ``resolved`` the seeds' (request_id, seed_id, k) where known.

    Exact, without pairing items: items with equal tag sets form one
    signature, and each signature offers only its first kmax+1 items by name
    (equal score inside it). Tags split by how many signatures hold them:

    * cold tags: (seed signature, candidate signature) pairs through the tag
      bridge; a pair's exact score is the size of the two tag sets' overlap;
    * hot tags (over ``hot_share`` of the signatures, so few whatever the data):
      candidates are grouped by their *hot projection* (the hot tags they
      hold); a group's first kmax+1 items by name score at least |seed's hot
      tags & projection|.

    An item's score is the max over both paths: exact, because an item
    sharing a cold tag has its exact score from the cold path, and an item
    left out of its projection group has kmax+1 items ahead of it in that
    group that score at least as much. Per seed signature kmax+1 candidates
    survive (partial WindowGroupLimit); each seed then drops itself, keeps k.
    """
    kmax = max_k(seeds if resolved is None else resolved) if kmax is None else kmax
    keep = kmax + 1
    index = index or RelatedIndex.build(catalog, keep, hot_share)
    if index.keep < keep:
        raise ValueError(f"the index serves lists of {index.keep - 1} items, {kmax} are asked for")
    resolved = (resolve_seeds(seeds, catalog) if resolved is None else resolved).filter(F.col("k") > 0)
    seed_sig = materialize(spread(resolved).join(spread(index.signatures.withColumnRenamed("base_item_id", "seed_id")), "seed_id")
                           .withColumnRenamed("sig", "a"))
    order = [F.col("shared_tag_count").desc()] + _by_name()
    a_tags = (seed_sig.select("a").distinct()
              .select("a", F.explode(F.split("a", ",")).alias("tag")))
    b_tags = index.tags.withColumnRenamed("sig", "b")

    # cold path: pairs through cold tags, exact overlap size
    pairs = (a_tags.join(index.hot, "tag", "left_anti")
             .join(b_tags.join(index.hot, "tag", "left_anti"), "tag")
             .select("a", "b").distinct()
             .withColumn("shared_tag_count",
                         F.size(F.array_intersect(F.split("a", ","), F.split("b", ","))).cast("int")))
    cold = pairs.join(index.by_signature.withColumnRenamed("sig", "b"), "b").select(
        "a", "base_item_id", "name", "name_key", "shared_tag_count")

    # hot path: candidates grouped by the hot tags they hold
    p_tags = index.projections.select("hp").distinct().select("hp", F.explode(F.split("hp", ",")).alias("tag"))
    hot_scores = (a_tags.join(index.hot, "tag", "left_semi").join(p_tags, "tag")
                  .groupBy("a", "hp").agg(F.count(F.lit(1)).cast("int").alias("shared_tag_count")))
    warm = hot_scores.join(index.by_projection, "hp").select("a", "base_item_id", "name", "name_key", "shared_tag_count")

    merged = (cold.unionByName(warm)
              .groupBy("a", "base_item_id", "name", "name_key")
              .agg(F.max("shared_tag_count").alias("shared_tag_count")))
    a_top = top_k(merged, ["a"], order, keep, rank_col="_ra").drop("_ra")
    per_seed = (seed_sig.select("request_id", "k", "seed_id", "a").join(a_top, "a")
                .filter(F.col("base_item_id") != F.col("seed_id")))
    ranked = top_k(per_seed, ["request_id"], order, F.col("k"))
    return _display(ranked, catalog).select(
        "request_id", "rank", "item_name", "brand_name", "thumbnail_url", "shared_tag_count")


def more_from_brand(seeds: DataFrame, catalog: Catalog, kmax: int | None = None) -> DataFrame:
    """First k items of the seed's brand whose name differs (CI) from the seed's.

    Output (request_id, rank, item_name, brand_name, thumbnail_url). The seed
    item need not exist. Per brand only the first kmax+1 distinct names, and
    within each name only kmax items, can ever be shown -- whichever name a
    seed excludes -- so requests join a candidate list of bounded size.
    """
    kmax = max_k(seeds) if kmax is None else kmax
    asked = seeds.select(name_key("brand_name").alias("brand_key")).distinct()
    brands = (catalog.brand.select("brand_id", F.col("name_key").alias("brand_key"))
              .join(asked, "brand_key", "left_semi"))  # only brands some seed names
    items = catalog.base_item.select("base_item_id", "name", "name_key", "brand_id").join(
        brands, "brand_id")
    by_name = [F.col("name").asc_nulls_last(), F.col("base_item_id").asc()]
    per_name = top_k(items, ["brand_key", "name_key"], by_name, max(kmax, 1), rank_col="_rn").drop("_rn")
    first_names = top_k(per_name.select("brand_key", "name_key").distinct(), ["brand_key"],
                        [F.col("name_key").asc()], kmax + 1, rank_col="_rk").drop("_rk")
    cand = per_name.join(first_names, ["brand_key", "name_key"], "left_semi")
    s = (seeds.select("request_id", _k().alias("k"),
                      name_key("base_item_name").alias("seed_nk"),
                      name_key("brand_name").alias("brand_key"))
         .filter(F.col("k") > 0))
    joined = s.join(cand, "brand_key").filter(F.col("name_key") != F.col("seed_nk"))
    ranked = top_k(joined, ["request_id"], [F.col("name_key").asc()] + by_name, F.col("k"))
    return _display(ranked.select("request_id", "rank", "base_item_id"), catalog).select(
        "request_id", "rank", "item_name", "brand_name", "thumbnail_url")


def more_like(seeds: DataFrame, catalog: Catalog, index: RelatedIndex | None = None) -> DataFrame:
    """Both lists, tagged by ``kind``; (request_id, kind, rank, item_name,
    brand_name, thumbnail_url)."""
    kmax = max_k(seeds)
    sim = similar_items(seeds, catalog, kmax, index=index).drop("shared_tag_count") \
        .withColumn("kind", F.lit("similar_items"))
    mfb = more_from_brand(seeds, catalog, kmax).withColumn("kind", F.lit("more_from_brand"))
    cols = ["request_id", "kind", "rank", "item_name", "brand_name", "thumbnail_url"]
    return sim.select(cols).unionByName(mfb.select(cols))
