"""Table-wide derived values (D1, D3): built-in expressions and grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STARS = 5


def star_buckets(rating) -> dict:
    """Full, half and empty stars of a rating: full = floor(r); half when the
    fraction is in [0.25, 0.75); empty = 5 - full - half (>= .75 is not rounded up)."""
    full = F.floor(rating).cast("int")
    frac = rating - F.floor(rating)
    half = ((frac >= F.lit(0.25)) & (frac < F.lit(0.75))).cast("int")
    return {"full_stars": full, "half_star": half,
            "empty_stars": (F.lit(MAX_STARS) - full - half).cast("int")}


def rating_buckets(base_item: DataFrame) -> DataFrame:
    """(brand_id, full_stars, half_star, empty_stars, n_items) over rated items."""
    b = star_buckets(F.col("rating"))
    return (base_item.filter(F.col("rating").isNotNull())
            .select("brand_id", *[v.alias(k) for k, v in b.items()])
            .groupBy("brand_id", "full_stars", "half_star", "empty_stars")
            .agg(F.count(F.lit(1)).alias("n_items")))


def users_by_role(site_user: DataFrame) -> DataFrame:
    """D3: (role, n_users) with Admin > Staff > Member."""
    role = (F.when(F.col("is_admin"), "Admin").when(F.col("is_staff"), "Staff")
            .otherwise("Member"))
    return site_user.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n_users"))
