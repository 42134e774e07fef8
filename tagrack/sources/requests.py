"""Request tables derived from the driver's ``events`` log.

The reference answers one HTTP request at a time; we answer whole tables of
them. Each event type stands for one kind of request, so the request volume
grows with the data: ``view`` = browse, ``click`` = similar / more-like seed,
``error`` = search box input, ``purchase`` = item detail. Values vary with the
event id so every edge case of the reference occurs (null and empty tag
lists, unknown tags, case variants, page 0, negative k, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import spread
from .tables import Tables

# Ids of announced items: beyond every part key.
DRAFTS_FROM = 1_000_000_000_000


def _events_with_part(t: Tables, event_type: str) -> DataFrame:
    e = t.events.filter(F.col("event_type") == event_type).select("event_id", "user_id")
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    return e.join(spread(p), e.user_id == p.p_partkey, "left")


def _w(n: int):
    return F.split_part(F.col("p_name"), F.lit(" "), F.lit(n))


def browse_requests(t: Tables) -> DataFrame:
    """(request_id, page_index, items_per_page, include_tags) from ``view`` events."""
    x = _events_with_part(t, "view")
    eid, uid = F.col("event_id"), F.col("user_id")
    null_s = F.lit(None).cast("string")
    tags = (F.when(uid % 7 == 0, F.lit(None).cast("array<string>"))
            .when(uid % 7 == 1, F.array(F.upper(_w(1))))
            .when(uid % 7 == 2, F.array(_w(1), F.upper(_w(1)), F.lower("p_type")))
            .when(uid % 7 == 3, F.array(_w(1), _w(2)))
            .when(uid % 7 == 4, F.array(_w(2), null_s))
            .when(uid % 7 == 5, F.array(F.lit("No-Such-Tag")))
            .otherwise(F.array().cast("array<string>")))
    return x.select(
        F.col("event_id").alias("request_id"),
        (eid % 4).cast("int").alias("page_index"),
        F.when(eid % 5 == 0, F.lit(None)).otherwise((eid % 7 * 10).cast("int")).alias("items_per_page"),
        tags.alias("include_tags"))


def http_browse_requests(t: Tables) -> DataFrame:
    """Raw HTTP browse calls: (request_id, path_tag, query_tags, page, page_size) as text."""
    x = _events_with_part(t, "view")
    eid, uid = F.col("event_id"), F.col("user_id")
    return x.select(
        F.col("event_id").alias("request_id"),
        F.when(eid % 10 == 3, F.lit(None).cast("string")).otherwise(F.coalesce(_w(1), F.lit("all"))).alias("path_tag"),
        F.when(uid % 3 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.coalesce(F.lower("p_type"), F.lit("x")))).alias("query_tags"),
        F.when(eid % 6 == 0, F.lit(None)).when(eid % 12 == 1, F.lit("x")).when(eid % 12 == 7, F.lit("2x"))
         .when(eid % 12 == 2, F.lit("")).when(eid % 12 == 8, F.lit(" 3"))
         .otherwise((eid % 4).cast("string")).alias("page"),
        F.when(eid % 5 == 0, F.lit(None))
         .otherwise((eid % 7 * 20).cast("string")).alias("page_size"))


def seed_requests(t: Tables) -> DataFrame:
    """(request_id, base_item_name, brand_name, k) from ``click`` events."""
    x = _events_with_part(t, "click")
    eid = F.col("event_id")
    name = F.when(eid % 2 == 0, F.lower("p_name")).otherwise(F.col("p_name"))
    brand = F.when(eid % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    k = (F.when(eid % 7 == 0, F.lit(None)).when(eid % 7 == 1, F.lit(-1))
         .when(eid % 7 == 2, F.lit(1)).otherwise(F.lit(4)))
    return x.select(eid.alias("request_id"), name.alias("base_item_name"),
                    brand.alias("brand_name"), k.cast("int").alias("k"))


def search_requests(t: Tables) -> DataFrame:
    """(query_id, q) from ``error`` events: infixes, prefixes, wildcards, accents."""
    x = _events_with_part(t, "error")
    eid = F.col("event_id")
    q = (F.when(eid % 8 == 0, F.substring(_w(1), 2, 3))
         .when(eid % 8 == 1, F.upper(F.substring(_w(2), 1, 2)))
         .when(eid % 8 == 2, F.lit(""))
         .when(eid % 8 == 3, F.lit(None).cast("string"))
         .when(eid % 8 == 4, F.concat(F.substring(_w(1), 1, 1), F.lit("%"), F.substring(_w(2), 1, 1)))
         .when(eid % 8 == 5, F.lit("É"))
         .when(eid % 8 == 6, F.concat(F.lit("_"), F.substring(_w(2), 2, 2)))
         .when(eid % 32 == 7, F.concat(F.substring(_w(1), 1, 1), F.lit("\\"), F.substring(_w(1), 2, 2)))
         .when(eid % 32 == 15, F.concat(F.substring(_w(2), 1, 2), F.lit("\\")))
         .when(eid % 64 == 23, F.lit("a\\%")).when(eid % 64 == 55, F.lit("__"))
         .otherwise(F.concat(F.lit("  "), F.substring("p_brand", 1, 5), F.lit(" "))))
    return x.select(eid.alias("query_id"), q.alias("q"))


def detail_requests(t: Tables) -> DataFrame:
    """(request_id, base_item_name, brand_name) from ``purchase`` events."""
    x = _events_with_part(t, "purchase")
    eid = F.col("event_id")
    name = (F.when(eid % 11 == 0, F.lit(None).cast("string"))
            .when(eid % 11 == 1, F.lit("no such item"))
            .when(eid % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    brand = (F.when(eid % 5 == 0, F.lit(None).cast("string"))
             .when(eid % 5 == 1, F.lower("p_brand"))
             .when(eid % 13 == 2, F.lit("Brand#999"))
             .otherwise(F.col("p_brand")))
    return x.select(eid.alias("request_id"), name.alias("base_item_name"), brand.alias("brand_name"))


def _events_with_customer(t: Tables, event_type: str) -> DataFrame:
    e = t.events.filter(F.col("event_type") == event_type).select("event_id", "user_id")
    c = t.customer.select("c_custkey", "c_name")
    return e.join(spread(c), e.user_id == c.c_custkey, "left")


def signups(t: Tables) -> DataFrame:
    """(seq, first_name, last_name, username, email) from ``signup`` events."""
    x = _events_with_customer(t, "signup")
    eid, uid = F.col("event_id"), F.col("user_id")
    username = (F.when(eid % 4 == 0, F.col("c_name")).when(eid % 4 == 1, F.lower("c_name"))
                .when(eid % 4 == 2, F.concat(F.lit("new-"), uid.cast("string")))
                .otherwise(F.concat(F.lit("new-"), eid.cast("string"))))
    email = (F.when(eid % 5 == 0, F.upper(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")),
                                                    F.lit("@example.com"))))
             .when(eid % 5 == 1, F.lit("not an email"))
             .when(eid % 5 == 2, F.lit(None).cast("string"))
             .when(eid % 5 == 3, F.concat(F.lit("u"), eid.cast("string"), F.lit("@example.org")))
             .otherwise(F.concat(F.lit("U"), F.floor(eid / 40).cast("string"), F.lit("@example.org"))))
    return x.select(eid.alias("seq"), F.lit("New").alias("first_name"),
                    F.concat(F.lit("User"), uid.cast("string")).alias("last_name"),
                    username.alias("username"), email.alias("email"))


def session_closes(t: Tables) -> DataFrame:
    """(session_token) to sign out, from ``error`` events (some unknown)."""
    e = t.events.filter(F.col("event_type") == "error")
    return e.select(F.concat(F.lit("tok-"), (F.col("event_id") - 1).cast("string")).alias("session_token"))


def closet_adds(t: Tables) -> DataFrame:
    """(seq, username, closet_name) from ``purchase`` events."""
    x = _events_with_customer(t, "purchase")
    eid = F.col("event_id")
    user = F.when(eid % 9 == 0, F.lit("nobody")).otherwise(F.col("c_name"))
    name = (F.when(eid % 3 == 0, F.lit("1-URGENT")).when(eid % 3 == 1, F.lit("Favorites"))
            .otherwise(F.concat(F.lit("Wishlist "), (eid % 4).cast("string"))))
    return x.select(eid.alias("seq"), user.alias("username"), name.alias("closet_name"))


def closet_removes(t: Tables) -> DataFrame:
    """(seq, username, closet_name) from ``error`` events."""
    x = _events_with_customer(t, "error")
    eid = F.col("event_id")
    name = (F.when(eid % 3 == 0, F.lit("5-LOW")).when(eid % 3 == 1, F.lit("2-HIGH"))
            .otherwise(F.lit("Nope")))
    return x.select(eid.alias("seq"), F.col("c_name").alias("username"), name.alias("closet_name"))


def closet_requests(t: Tables) -> DataFrame:
    """(request_id, username) from ``signup`` events; some are unknown or spelled in another case."""
    x = _events_with_customer(t, "signup")
    eid = F.col("event_id")
    name = (F.when(eid % 7 == 0, F.lower("c_name")).when(eid % 11 == 0, F.lit("nobody")).otherwise(F.col("c_name")))
    return x.select(eid.alias("request_id"), name.alias("username"))


def logins(t: Tables) -> DataFrame:
    """(seq, email, session_token, created_at) from ``signup`` events: sign-ins by
    e-mail in either case, some unknown."""
    e = t.events.filter(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    x = e.join(t.customer.select("c_custkey", "c_name"), e.user_id == F.col("c_custkey"), "left")
    mail = F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@example.com"))
    eid = F.col("event_id")
    return x.select(eid.alias("seq"), F.when(eid % 6 == 0, F.upper(mail)).when(eid % 6 == 1, F.lit("no@example.com")).otherwise(mail).alias("email"),
                    F.concat(F.lit("in-"), eid.cast("string")).alias("session_token"),
                    (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def closet_item_adds(t: Tables) -> DataFrame:
    """(seq, username, closet_name, base_item_name, brand_name) from ``click`` events."""
    x = _events_with_customer(t, "click")
    p = t.part.select("p_partkey", "p_name", "p_brand")
    x = x.join(p, x.user_id == p.p_partkey, "left")
    eid = F.col("event_id")
    name = F.when(eid % 6 == 5, F.lit("Nope"))
    for i, pr in enumerate(PRIORITIES):
        name = name.when(eid % 6 == i, F.lit(pr))
    brand = F.when(eid % 10 == 0, F.lit("Brand#999")).otherwise(F.col("p_brand"))
    return x.select(eid.alias("seq"), F.col("c_name").alias("username"), name.alias("closet_name"),
                    F.lower("p_name").alias("base_item_name"), brand.alias("brand_name"))


def delete_requests(t: Tables) -> DataFrame:
    """(base_item_id) to delete, from ``view`` events' users; some are no items."""
    e = t.events.filter(F.col("event_type") == "view")
    unknown = F.when(F.col("event_id") % 9 == 0, -F.col("user_id")).otherwise(F.col("user_id"))
    return e.select(unknown.alias("base_item_id")).distinct()


def delete_requests_with_drafts(t: Tables) -> DataFrame:
    """(base_item_id): the same and, for each of those users, the announced item of
    the supplier with that number (many do not exist)."""
    ids = delete_requests(t)
    return ids.unionByName(ids.select((F.lit(DRAFTS_FROM) + F.abs("base_item_id")).alias("base_item_id")))


def tag_deletes(t: Tables) -> DataFrame:
    """(tag_id) from ``click`` events' users, folded to a few hundred ids."""
    e = t.events.filter(F.col("event_type") == "click")
    return e.select((F.col("user_id") % 400).cast("int").alias("tag_id"))


def brand_deletes(t: Tables) -> DataFrame:
    """(brand_id) from ``error`` events: item brands, and brands known from texts only."""
    e = t.events.filter(F.col("event_type") == "error")
    return e.select(F.when(F.col("event_id") % 2 == 0, F.col("user_id") % 60)
                    .otherwise(F.lit(100000) + F.col("user_id")).cast("long").alias("brand_id"))


def user_deletes(t: Tables) -> DataFrame:
    """(site_user_id) from ``signup`` events; some are no users."""
    e = t.events.filter(F.col("event_type") == "signup")
    return e.select(F.when(F.col("event_id") % 8 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("site_user_id"))


def raw_stock_events(events: DataFrame) -> DataFrame:
    """Stock events as a client might send them: some with an unknown or missing
    type, no quantity, a negative count, or an unknown item."""
    k = F.col("l_orderkey") % 41
    return events.withColumns({
        "transaction_event": F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("lost"))
        .otherwise(F.col("transaction_event")),
        "quantity": F.when(k == 2, F.lit(None).cast("long")).when(k == 3, -F.col("quantity")).otherwise(F.col("quantity")),
        "item_id": F.when(k == 4, -F.col("item_id")).otherwise(F.col("item_id"))})
