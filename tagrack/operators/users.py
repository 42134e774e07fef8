"""Users, sessions and closets as table-to-table changes.

Commands arrive as DataFrames with a ``seq`` column (arrival order); each
returns ``(new state, status per command)``. Where the reference raises an
exception we emit a status code instead; where it silently does nothing we
report ``ok`` or a distinct code and leave the state as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.ranking import positions
from ..functions.text import name_key
from ..model import DEFAULT_CLOSET, EMAIL_REGEX, SESSION_LIFETIME, Catalog
from ..plans.materialize import materialize, written


# Signups that one fold goes through in order.
REPLAY_ROWS = 2_000


def _next_ids(rows: DataFrame, id_col: str, existing: DataFrame, existing_id: str,
              order: str = "seq") -> DataFrame:
    """Give new rows ids max(existing)+1.. in ``order``, numbered by a
    range-partitioned sort (never in one task); the current max is one
    scalar aggregate."""
    top = existing.agg(F.max(existing_id)).first()[0]
    numbered = positions(rows, [], [order], pos_col="_pos")
    return numbered.withColumn(id_col, (F.lit(int(top or 0)) + F.col("_pos")).cast("long")).drop("_pos")


def register_users(users: DataFrame, signups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk sign-up in ``seq`` order.

    Checks: required fields, email pattern, username unique (case-sensitive),
    email unique (case-insensitive) against existing users and against the
    signups accepted before it. Returns (new users, statuses (seq, status, site_user_id)).
    """
    new, statuses = accepted_signups(users, signups)
    return users.unionByName(new, allowMissingColumns=True), statuses


def accepted_signups(users: DataFrame, signups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the new users, statuses) of U30."""
    req = signups.withColumn("email_key", name_key("email"))
    missing = (F.col("first_name").isNull() | F.col("last_name").isNull()
               | F.col("username").isNull() | F.col("email").isNull())
    taken_u = users.select("username").distinct().withColumn("_tu", F.lit(True))
    taken_e = users.select(name_key("email").alias("email_key")).distinct().withColumn("_te", F.lit(True))
    x = req.join(taken_u, "username", "left").join(taken_e, "email_key", "left")
    status = (F.when(missing, "missing_field")
              .when(~F.col("email").rlike(EMAIL_REGEX), "bad_email")
              .when(F.col("_tu").isNotNull(), "username_taken")
              .when(F.col("_te").isNotNull(), "email_taken"))
    x = x.withColumn("status", status).drop("_tu", "_te")
    settled = x.filter(F.col("status").isNotNull()).select("seq", "status")
    pending = x.filter(F.col("status").isNull()).select("seq", "username", "email_key")
    first = _first_come(pending)
    settled = settled.unionByName(pending.join(first, "seq", "left_anti").select("seq", F.lit("duplicate_in_batch").alias("status")))
    accepted = req.join(first, "seq", "left_semi")
    new_users = _next_ids(accepted, "site_user_id", users, "site_user_id").select(
        "site_user_id", "first_name", "last_name", "username", "email",
        F.lit(False).alias("is_staff"), F.lit(False).alias("is_admin"), "seq")
    statuses = (settled.withColumn("site_user_id", F.lit(None).cast("long"))
                .unionByName(new_users.select("seq", F.lit("ok").alias("status"), "site_user_id")))
    return new_users.drop("seq"), statuses


def _first_come(pending: DataFrame) -> DataFrame:
    """(seq) of the signups (seq, username, email_key) that are accepted one after
    another, each if neither its username nor its email is taken by then.

    Of one (username, email) pair only the first can be. A signup that shares
    neither with others is; the rest fall into groups that share, found as
    connected components, and each group of up to ``REPLAY_ROWS`` rows is
    gone through in order by one fold, so a chain of clashes costs no rounds.
    In a larger group those that come first for both their names are accepted,
    those that clash with them go, and what is left is grouped anew.
    """
    pairs = materialize(pending.groupBy("username", "email_key").agg(F.min("seq").alias("seq")))
    shared = [pairs.groupBy(c).agg(F.count("*").alias(n)) for c, n in (("username", "_u"), ("email_key", "_e"))]
    marked = materialize(pairs.join(shared[0], "username").join(shared[1], "email_key"))
    accepted = [marked.where("_u = 1 and _e = 1").select("seq")]
    left = marked.where("_u > 1 or _e > 1").select("seq", "username", "email_key")
    n = left.count()
    while n > REPLAY_ROWS:
        # a collision of hashes only joins two groups
        keyed = left.select("*", F.xxhash64(F.lit("u"), "username").alias("a"), F.xxhash64(F.lit("e"), "email_key").alias("b"))
        keyed = materialize(keyed.join(components(keyed.select("a", "b")).withColumnRenamed("id", "a"), "a"))
        sizes = keyed.groupBy("component").agg(F.count("*").alias("n"))
        small = sizes.where(F.col("n") <= REPLAY_ROWS).select("component")
        accepted.append(_replayed(keyed.join(small, "component", "left_semi")))
        large = materialize(keyed.join(small, "component", "left_anti").select("seq", "username", "email_key"))
        firsts = [large.groupBy(c).agg(F.min("seq").alias("seq")).select("seq") for c in ("username", "email_key")]
        win = materialize(large.join(firsts[0], "seq", "left_semi").join(firsts[1], "seq", "left_semi"))
        accepted.append(win.select("seq"))
        left = materialize(large.join(win.select("username"), "username", "left_anti").join(win.select("email_key"), "email_key", "left_anti"))
        n = left.count()
    if n:
        accepted.append(_replayed(left.withColumn("component", F.lit(0))))
    return materialize(_union(accepted))


def _replayed(rows: DataFrame) -> DataFrame:
    """(seq) accepted in each ``component``, gone through in order of seq."""
    queue = rows.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("seq", "username", "email_key"))).alias("q"))
    none = F.struct(F.array().cast("array<string>").alias("u"), F.array().cast("array<string>").alias("e"), F.array().cast("array<bigint>").alias("ok"))
    add = lambda acc, x: F.struct(F.array_append(acc["u"], x["username"]).alias("u"), F.array_append(acc["e"], x["email_key"]).alias("e"),
                                  F.array_append(acc["ok"], x["seq"].cast("bigint")).alias("ok"))
    taken = lambda acc, x: F.array_contains(acc["u"], x["username"]) | F.array_contains(acc["e"], x["email_key"])
    gone = F.aggregate("q", none, lambda acc, x: F.when(taken(acc, x), acc).otherwise(add(acc, x)))
    return queue.select(F.explode(gone["ok"]).alias("seq")).select(F.col("seq").cast(rows.schema["seq"].dataType).alias("seq"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def default_closets(new_users: DataFrame, closets: DataFrame, as_of) -> DataFrame:
    """The 'Favorites' closet every new user gets (ids continue the table)."""
    rows = new_users.select("site_user_id", F.col("site_user_id").alias("seq"))
    return _next_ids(rows, "closet_id", closets, "closet_id").select(
        "closet_id", "site_user_id", F.lit(DEFAULT_CLOSET).alias("name"),
        F.lit(as_of).alias("created_at"))


def open_sessions(sessions: DataFrame | None, opens: DataFrame) -> DataFrame:
    """A user keeps only the newest session (created_at, then session_id);
    expires_at = created_at + 1 day. ``sessions`` is the current table (None
    when there is none yet). A per-user max_by aggregate: combined map-side,
    so a user with very many logins is never one task's load."""
    cols = ["session_id", "site_user_id", "session_token", "created_at"]
    both = opens.select(*cols)
    if sessions is not None:
        both = sessions.select(*cols).unionByName(both)
    latest = both.groupBy("site_user_id").agg(
        F.max_by(F.struct("session_id", "session_token", "created_at"),
                 F.struct("created_at", "session_id")).alias("s"))
    return latest.select("s.session_id", "site_user_id", "s.session_token", "s.created_at",
                         (F.col("s.created_at") + F.expr(SESSION_LIFETIME)).alias("expires_at"))


def sign_in(sessions: DataFrame, users: DataFrame, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U31 from the sign-in side: logins (seq, email, session_token, created_at)
    find the user by email (case-insensitive); unknown emails are rejected
    (``unknown_email``; the password check itself is not table work). Known
    logins open sessions, replacing the user's older one. Returns
    (sessions, statuses (seq, status, site_user_id))."""
    by_email = users.select(name_key("email").alias("_ek"), "site_user_id")
    x = logins.withColumn("_ek", name_key("email")).join(by_email, "_ek", "left").drop("_ek")
    status = F.when(F.col("site_user_id").isNull(), "unknown_email").otherwise("ok")
    statuses = x.select("seq", status.alias("status"), "site_user_id")
    opens = x.filter(F.col("site_user_id").isNotNull()).select(
        F.col("seq").alias("session_id"), "site_user_id", "session_token", "created_at")
    return open_sessions(sessions, opens), statuses


def active_sessions(sessions: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """U32: sessions with expires_at > as_of whose token occurs exactly once,
    with the user's profile: (session_token, site_user_id, username, email,
    first_name, last_name, is_staff, is_admin)."""
    live = sessions.filter(F.col("expires_at") > F.lit(as_of))
    unique_tok = live.groupBy("session_token").agg(F.count(F.lit(1)).alias("_n")) \
        .filter(F.col("_n") == 1).select("session_token")
    return (live.join(unique_tok, "session_token", "left_semi")
            .join(users, "site_user_id")
            .select("session_token", "site_user_id", "username", "email", "first_name",
                    "last_name", "is_staff", "is_admin"))


def close_sessions(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Drop sessions whose token is given; unknown tokens do nothing."""
    return sessions.join(tokens.select("session_token"), "session_token", "left_anti")


def _user_ids(users: DataFrame) -> DataFrame:
    return users.select("username", "site_user_id")


def add_closets(closets: DataFrame, users: DataFrame, adds: DataFrame, as_of
                ) -> tuple[DataFrame, DataFrame]:
    """(seq, username, closet_name) -> unknown_user, duplicate (already
    there or an earlier add in the batch) or ok with a new closet_id."""
    new, statuses = new_closets(closets, users, adds, as_of)
    return closets.unionByName(new, allowMissingColumns=True), statuses


def new_closets(closets: DataFrame, users: DataFrame, adds: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(rows of the new closets, statuses) of U34."""
    x = adds.join(_user_ids(users), "username", "left")
    existing = closets.select("site_user_id", F.col("name").alias("closet_name"),
                              F.lit(True).alias("_exists"))
    x = x.join(existing, ["site_user_id", "closet_name"], "left")
    first = (x.filter(F.col("site_user_id").isNotNull())
             .groupBy("site_user_id", "closet_name").agg(F.min("seq").alias("_first")))
    x = x.join(first, ["site_user_id", "closet_name"], "left")
    status = (F.when(F.col("site_user_id").isNull(), "unknown_user")
              .when(F.col("_exists").isNotNull() | (F.col("seq") != F.col("_first")), "duplicate")
              .otherwise("ok"))
    x = x.withColumn("status", status)
    new = _next_ids(x.filter(F.col("status") == "ok"), "closet_id", closets, "closet_id")
    rows = new.select("closet_id", "site_user_id", F.col("closet_name").alias("name"), F.lit(as_of).alias("created_at"))
    statuses = (x.filter(F.col("status") != "ok")
                .select("seq", "status", F.lit(None).cast("long").alias("closet_id"))
                .unionByName(new.select("seq", "status", "closet_id")))
    return rows, statuses


def remove_closets(closets: DataFrame, closet_items: DataFrame, users: DataFrame,
                   removes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete closets by (username, closet_name), cascading to their items.
    Statuses: unknown_user, unknown_closet (incl. removed earlier in the batch), ok.
    Returns (closets, closet_items, statuses (seq, status, closet_id))."""
    statuses = closet_removals(closets, users, removes)
    gone = statuses.filter(F.col("status") == "ok").select("closet_id")
    return (closets.join(gone, "closet_id", "left_anti"),
            closet_items.join(gone, "closet_id", "left_anti"), statuses)


def closet_removals(closets: DataFrame, users: DataFrame, removes: DataFrame) -> DataFrame:
    """The statuses of U35, with the id of each closet that goes."""
    x = removes.join(_user_ids(users), "username", "left")
    found = closets.select("closet_id", "site_user_id", F.col("name").alias("closet_name"))
    x = x.join(found, ["site_user_id", "closet_name"], "left")
    first = (x.filter(F.col("closet_id").isNotNull()).groupBy("closet_id")
             .agg(F.min("seq").alias("_first")))
    x = x.join(first, "closet_id", "left")
    status = (F.when(F.col("site_user_id").isNull(), "unknown_user")
              .when(F.col("closet_id").isNull() | (F.col("seq") != F.col("_first")), "unknown_closet")
              .otherwise("ok"))
    return x.select("seq", status.alias("status"),
                    F.when(status == "ok", F.col("closet_id")).cast("long").alias("closet_id"))


def add_items_to_closets(closets: DataFrame, closet_items: DataFrame, users: DataFrame,
                         catalog: Catalog, adds: DataFrame, as_of
                         ) -> tuple[DataFrame, DataFrame]:
    """(seq, username, closet_name, base_item_name, brand_name).

    User and closet name match exactly, item and brand case-insensitively
    (smallest id if several). Statuses: unknown_user, unknown_closet,
    unknown_item, already_present (kept as is), ok (row added).
    """
    new, statuses = new_closet_items(closets, closet_items, users, catalog, adds, as_of)
    return closet_items.unionByName(new, allowMissingColumns=True), statuses


def new_closet_items(closets: DataFrame, closet_items: DataFrame, users: DataFrame,
                     catalog: Catalog, adds: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(rows of the new entries, statuses) of U36."""
    x = adds.join(_user_ids(users), "username", "left")
    found = closets.select("closet_id", "site_user_id", F.col("name").alias("closet_name"))
    x = x.join(found, ["site_user_id", "closet_name"], "left")
    x = (x.withColumn("name_key", name_key("base_item_name"))
         .withColumn("brand_key", name_key("brand_name")))
    asked = x.select("name_key", "brand_key").distinct()   # aggregate only requested keys
    keyed = (catalog.base_item.select("base_item_id", "name_key", "brand_id")
             .join(catalog.brand.select("brand_id", F.col("name_key").alias("brand_key")), "brand_id")
             .join(asked, ["name_key", "brand_key"], "left_semi")
             .groupBy("name_key", "brand_key").agg(F.min("base_item_id").alias("item_id")))
    x = x.join(keyed, ["name_key", "brand_key"], "left")
    present = closet_items.select("closet_id", "item_id").withColumn("_present", F.lit(True))
    x = x.join(present, ["closet_id", "item_id"], "left")
    first = (x.filter(F.col("closet_id").isNotNull() & F.col("item_id").isNotNull())
             .groupBy("closet_id", "item_id").agg(F.min("seq").alias("_first")))
    x = x.join(first, ["closet_id", "item_id"], "left")
    status = (F.when(F.col("site_user_id").isNull(), "unknown_user")
              .when(F.col("closet_id").isNull(), "unknown_closet")
              .when(F.col("item_id").isNull(), "unknown_item")
              .when(F.col("_present").isNotNull() | (F.col("seq") != F.col("_first")), "already_present")
              .otherwise("ok"))
    x = written(x.select("seq", status.alias("status"), "closet_id", "item_id"), "closet-adds")  # read by both results
    new_rows = x.filter(F.col("status") == "ok").select(
        "closet_id", "item_id", F.lit(as_of).alias("added_at"))
    statuses = x.select("seq", "status", "closet_id", "item_id")
    return new_rows, statuses


def user_closets(users: DataFrame, closets: DataFrame, closet_items: DataFrame,
                 catalog: Catalog) -> DataFrame:
    """U37 (flat form): one row per (user, closet, item) with closet_rank by
    name and item_rank by name (CI); a closet without items gives one row with
    NULL item; a user without closets one row with NULL closet. Items need a
    brand (inner join), thumbnails are optional."""
    closets = closets.join(users.select("site_user_id"), "site_user_id", "left_semi")  # asked users only
    closet_items = closet_items.join(closets.select("closet_id"), "closet_id", "left_semi")
    items = (closet_items.select("closet_id", F.col("item_id").alias("base_item_id"))
             .join(catalog.base_item.select("base_item_id", "name", "name_key", "brand_id",
                                            "thumbnail_image_id"), "base_item_id")
             .join(catalog.brand.select("brand_id", F.col("name").alias("brand_name")), "brand_id")
             .join(catalog.image.select(F.col("image_id").alias("thumbnail_image_id"),
                                        F.col("url").alias("thumbnail_url")),
                   "thumbnail_image_id", "left"))
    ranked_items = positions(items, ["closet_id"], ["name_key", "name", "base_item_id"], pos_col="item_rank")
    ranked_closets = positions(closets.select("closet_id", "site_user_id", "name"),
                               ["site_user_id"], ["name", "closet_id"], pos_col="closet_rank")
    c = ranked_closets.join(ranked_items.select("closet_id", "item_rank",
                                                F.col("name").alias("item_name"),
                                                "brand_name", "thumbnail_url"),
                            "closet_id", "left")
    return (users.select("site_user_id", "username").join(c, "site_user_id", "left")
            .select("username", "closet_rank", F.col("name").alias("closet_name"), "item_rank",
                    "item_name", "brand_name", "thumbnail_url"))


def closets_by_name(requests: DataFrame, users: DataFrame, closets: DataFrame, closet_items: DataFrame,
                    catalog: Catalog) -> DataFrame:
    """U37 as it is called: (request_id, username) -> the user's closets with ids and
    dates, and what is in them.

    ``status`` is ``unknown_user`` (one row, nothing else), ``no_closets``, ``empty``
    (a closet without items) or ``item``. Closets and items are ranked once per asked
    user, whoever asks for them how often; usernames match exactly.
    """
    asked = (requests.select("username").distinct().join(users.select("username", "site_user_id"), "username"))
    closets = closets.join(asked.select("site_user_id"), "site_user_id", "left_semi")
    entries = closet_items.join(closets.select("closet_id"), "closet_id", "left_semi")
    items = (entries.select("closet_id", F.col("item_id").alias("base_item_id"), "added_at")
             .join(catalog.base_item.select("base_item_id", "name", "name_key", "brand_id", "thumbnail_image_id"), "base_item_id")
             .join(catalog.brand.select("brand_id", F.col("name").alias("brand_name")), "brand_id")
             .join(catalog.image.select(F.col("image_id").alias("thumbnail_image_id"), F.col("url").alias("thumbnail_url")),
                   "thumbnail_image_id", "left"))
    items = positions(items, ["closet_id"], ["name_key", "name", "base_item_id"], pos_col="item_rank").select(
        "closet_id", "item_rank", F.col("name").alias("item_name"), "brand_name", "thumbnail_url", "added_at")
    ranked = positions(closets.select("closet_id", "site_user_id", "name", "created_at"), ["site_user_id"], ["name", "closet_id"],
                       pos_col="closet_rank").withColumnRenamed("name", "closet_name")
    found = asked.join(ranked, "site_user_id", "left").join(items, "closet_id", "left")
    status = (F.when(F.col("site_user_id").isNull(), "unknown_user").when(F.col("closet_id").isNull(), "no_closets")
              .when(F.col("item_rank").isNull(), "empty").otherwise("item"))
    return requests.select("request_id", "username").join(found, "username", "left").select(
        "request_id", "username", status.alias("status"), "closet_id", "closet_rank", "closet_name", "created_at",
        "item_rank", "item_name", "brand_name", "thumbnail_url", "added_at")


def removed_entries(statuses: DataFrame, closet_items: DataFrame) -> DataFrame:
    """The statuses of U35 with the number of closet entries that go along."""
    gone = statuses.filter(F.col("status") == "ok").select("closet_id")
    n = closet_items.join(gone, "closet_id", "left_semi").groupBy("closet_id").agg(F.count(F.lit(1)).alias("n_entries"))
    return statuses.join(n, "closet_id", "left").select("seq", "status", "closet_id", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"))


def closet_item_counts(closets: DataFrame, closet_items: DataFrame) -> DataFrame:
    """(closet_id, n_items), 0 for empty closets."""
    n = closet_items.groupBy("closet_id").agg(F.count(F.lit(1)).alias("n_items"))
    return (closets.select("closet_id").join(n, "closet_id", "left")
            .select("closet_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items")))


def sign_up(users: DataFrame, closets: DataFrame, signups: DataFrame, as_of
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U30 in full: register users, then give each new user a 'Favorites'
    closet. Returns (users, closets, statuses)."""
    new_state, statuses = register_users(users, signups)
    ok = statuses.filter(F.col("status") == "ok").select("site_user_id")
    fav = default_closets(ok, closets, as_of)
    return new_state, closets.unionByName(fav, allowMissingColumns=True), statuses
