"""Named queries over the driver tables: ``QUERIES[name](spark, sf_dir) -> DataFrame``.

Each entry binds the driver's Parquet into the catalogue, derives its request
table from the data, and runs one operator over the whole of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import Catalog, size_rank
from ..operators import browse, detail, documents, ingest, integrity, related, search, stock, summaries, users
from ..sources import feed
from ..sources import requests as rq
from ..session import scratch_path
from ..sources.binding import Binding
from .materialize import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# -- browse (U1-U4, D5) -------------------------------------------------------
@query("resolve_tags")
def _resolve_tags(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return browse.resolve_tags(rq.browse_requests(b.t), b.tag).select("request_id", "n_in", "n_found")


@query("match_all_tags")
def _match_all_tags(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return browse.match_all_tags(rq.browse_requests(b.t), b.catalog())


@query("browse_page")
def _browse_page(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return browse.browse_page(rq.browse_requests(b.t), b.catalog())


@query("browse_totals")
def _browse_totals(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return browse.browse_totals(rq.browse_requests(b.t), b.catalog())


@query("browse_requests")
def _browse_requests(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return browse.validate_http_browse(rq.http_browse_requests(b.t))


# -- related items (U5-U7) -------------------------------------------------------
@query("similar_items")
def _similar_items(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return related.similar_items(rq.seed_requests(b.t), b.catalog())


@query("similar_items_indexed")
def _similar_items_indexed(spark, sf_dir):
    """The same from a kept index, opened anew, that serves longer lists as well."""
    b = Binding.of(spark, sf_dir)
    seeds, path = rq.seed_requests(b.t), scratch_path(spark, "related-index")
    related.RelatedIndex.build(b.catalog(), related.max_k(seeds) + 4, path=path)
    return related.similar_items(seeds, b.catalog(), index=related.RelatedIndex(spark, path))


@query("more_from_brand")
def _more_from_brand(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return related.more_from_brand(rq.seed_requests(b.t), b.catalog())


@query("more_like")
def _more_like(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return related.more_like(rq.seed_requests(b.t), b.catalog())


# -- search and brand index (U8-U11) ---------------------------------------------
@query("search_names")
def _search_names(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return search.search_names(rq.search_requests(b.t), b.catalog())


@query("search_names_indexed")
def _search_names_indexed(spark, sf_dir):
    """The same through kept postings: an index of tags and brands, extended by
    the item names that come later."""
    b = Binding.of(spark, sf_dir)
    names = search.searchable_names(b.catalog())
    index = search.NameIndex(spark, scratch_path(spark, "name-index"))
    index.extend(names.filter("kind <> 'items'"))
    index.extend(names.filter("kind = 'items'"))
    return search.search_names(rq.search_requests(b.t), None, index=index)


@query("normalize_queries")
def _normalize_queries(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return search.normalize_queries(rq.search_requests(b.t))


@query("brand_index")
def _brand_index(spark, sf_dir):
    return search.brand_index(Binding.of(spark, sf_dir).brand)


@query("brand_index_letters")
def _brand_index_letters(spark, sf_dir):
    return search.brand_index_letters(Binding.of(spark, sf_dir).brand)


# -- stock ledger (U17-U20) ------------------------------------------------------
# Names of a letter, and entries of a closet, in one document.
INDEX_BLOCK, CLOSET_BLOCK = 100, 20
LEDGER_CUT = "1998-01-01"  # events before it form the existing ledger in apply_stock_events


def _bound_fold(b: Binding, events=None, opening=None):
    ev = b.stock_event if events is None else events
    return stock.fold_stock_events(ev, stock.BOUND_ORDER, opening=opening)


@query("fold_stock_events")
def _fold_stock_events(spark, sf_dir):
    return _bound_fold(Binding.of(spark, sf_dir))


@query("stock_levels")
def _stock_levels(spark, sf_dir):
    return stock.closing_levels(Binding.of(spark, sf_dir).stock_event, stock.BOUND_ORDER)


@query("validate_stock_events")
def _validate_stock_events(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return stock.validate_stock_events(rq.raw_stock_events(b.stock_event), b.sku)


def _cut(at: str = LEDGER_CUT):
    from pyspark.sql import functions as F
    return F.lit(at).cast("timestamp_ntz")


def _snapshot(b: Binding, at: str):
    """The stock of every SKU right before a mark, written."""
    from pyspark.sql import functions as F
    return written(stock.closing_levels(b.stock_event.filter(F.col("transaction_date") < _cut(at)), stock.BOUND_ORDER)
                   .select(_cut(at).alias("mark"), "item_id", "stock_quantity"), "snapshot")


@query("apply_stock_events")
def _apply_stock_events(spark, sf_dir):
    """New events on top of the snapshot at the mark; the older ones are not folded again."""
    from pyspark.sql import functions as F
    b = Binding.of(spark, sf_dir)
    opening = _snapshot(b, LEDGER_CUT).drop("mark")
    new, _rejects = stock.fold_new_events(b.stock_event.filter(F.col("transaction_date") >= _cut()), b.sku, stock.BOUND_ORDER, opening)
    return stock.stock_levels(opening.withColumnRenamed("stock_quantity", "delta_quantity").unionByName(new.select("item_id", "delta_quantity")))


@query("apply_raw_stock_events")
def _apply_raw_stock_events(spark, sf_dir):
    """The same with events as clients send them: each with its delta and the
    stock after it, or with the reason of its refusal."""
    from pyspark.sql import functions as F
    b = Binding.of(spark, sf_dir)
    raw = rq.raw_stock_events(b.stock_event).filter(F.col("transaction_date") >= _cut())
    new, rejects = stock.fold_new_events(raw, b.sku, stock.BOUND_ORDER, _snapshot(b, LEDGER_CUT).drop("mark"))
    return new.withColumn("status", F.lit("ok")).unionByName(rejects, allowMissingColumns=True)


@query("stock_levels_at")
def _stock_levels_at(spark, sf_dir):
    """Levels at a time between two snapshots: the nearest one and the tail since."""
    b = Binding.of(spark, sf_dir)
    snapshots = _snapshot(b, "1996-01-01").unionByName(_snapshot(b, LEDGER_CUT))
    return stock.levels_at(snapshots, b.stock_event, stock.BOUND_ORDER, _cut("1996-09-01"))


# -- item detail (U12-U16), size rank (D4 / U40) ---------------------------------
@query("infer_brand")
def _infer_brand(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return detail.infer_brand(rq.detail_requests(b.t), b.catalog())


@query("resolve_items")
def _resolve_items(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return detail.resolve_items(rq.detail_requests(b.t), b.catalog())


@query("item_images")
def _item_images(spark, sf_dir):
    return detail.item_images(Binding.of(spark, sf_dir).catalog())


@query("size_availability")
def _size_availability(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return detail.size_availability(b.sku, stock.closing_levels(b.stock_event, stock.BOUND_ORDER))


@query("item_detail")
def _item_detail(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return detail.item_detail(rq.detail_requests(b.t), b.catalog(),
                              events=b.stock_event, order=stock.BOUND_ORDER)


@query("seed_sizes")
def _seed_sizes(spark, sf_dir):
    from pyspark.sql import functions as F
    sku = Binding.of(spark, sf_dir).sku
    return sku.select("item_id", "basic_size", size_rank(F.col("basic_size")).alias("relative_order"))


# -- JSON documents at the edge ----------------------------------------------------
@query("search_documents")
def _search_documents(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return documents.search_documents(rq.search_requests(b.t), b.catalog())


@query("browse_documents")
def _browse_documents(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return documents.browse_documents(rq.browse_requests(b.t), b.catalog())


@query("index_documents")
def _index_documents(spark, sf_dir):
    return documents.index_documents(Binding.of(spark, sf_dir).brand, block=INDEX_BLOCK)


@query("closet_documents")
def _closet_documents(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return documents.closet_documents(rq.closet_requests(b.t), b.catalog(), block=CLOSET_BLOCK)


# -- users, sessions, closets (U30-U38) ------------------------------------------
AS_OF = "2024-01-29 12:00:00"  # late in the log, so some sessions have expired


def _as_of():
    from pyspark.sql import functions as F
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("register_users")
def _register_users(spark, sf_dir):
    """Statuses of the sign-ups plus the id of each new user's 'Favorites' closet."""
    from pyspark.sql import functions as F
    b = Binding.of(spark, sf_dir)
    _users, closets, statuses = users.sign_up(b.site_user, b.closet, rq.signups(b.t), _as_of())
    fav = (closets.filter(F.col("name") == "Favorites")
           .join(statuses.select("site_user_id").filter(F.col("site_user_id").isNotNull()), "site_user_id")
           .select("site_user_id", F.col("closet_id").alias("favorites_closet_id")))
    return statuses.join(fav, "site_user_id", "left").select(
        "seq", "status", "site_user_id", "favorites_closet_id")


@query("open_sessions")
def _open_sessions(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return users.open_sessions(None, b.session_open)


@query("active_sessions")
def _active_sessions(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    s = users.open_sessions(None, b.session_open)
    return users.active_sessions(s, b.site_user, _as_of())


@query("close_sessions")
def _close_sessions(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    s = users.open_sessions(None, b.session_open)
    return users.close_sessions(s, rq.session_closes(b.t))


@query("add_closets")
def _add_closets(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    _state, statuses = users.add_closets(b.closet, b.site_user, rq.closet_adds(b.t), _as_of())
    return statuses


@query("remove_closets")
def _remove_closets(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    _c, _ci, statuses = users.remove_closets(b.closet, b.closet_item, b.site_user,
                                             rq.closet_removes(b.t))
    return statuses


@query("add_items_to_closets")
def _add_items_to_closets(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    _state, statuses = users.add_items_to_closets(b.closet, b.closet_item, b.site_user, b.catalog(),
                                                  rq.closet_item_adds(b.t), _as_of())
    return statuses


@query("user_closets")
def _user_closets(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return users.user_closets(b.site_user, b.closet, b.closet_item, b.catalog())


@query("closets_of_users")
def _closets_of_users(spark, sf_dir):
    """Closets by username, as the call asks for them: ids, dates, unknown users."""
    b = Binding.of(spark, sf_dir)
    return users.closets_by_name(rq.closet_requests(b.t), b.site_user, b.closet, b.closet_item, b.catalog())


@query("remove_closets_entries")
def _remove_closets_entries(spark, sf_dir):
    """Removals with the number of entries that go along."""
    b = Binding.of(spark, sf_dir)
    return users.removed_entries(users.closet_removals(b.closet, b.site_user, rq.closet_removes(b.t)), b.closet_item)


@query("sign_in")
def _sign_in(spark, sf_dir):
    """Sign-ins by e-mail on top of the open sessions: the sessions afterwards, and the refused."""
    from pyspark.sql import functions as F
    b = Binding.of(spark, sf_dir)
    sessions, statuses = users.sign_in(users.open_sessions(None, b.session_open), b.site_user, rq.logins(b.t))
    refused = statuses.filter(F.col("status") != "ok").select("status", F.col("seq").alias("session_id"))
    return sessions.withColumn("status", F.lit("ok")).unionByName(refused, allowMissingColumns=True)


@query("committed_closets")
def _committed_closets(spark, sf_dir):
    """Closets added, filled and removed and users deleted, each command committed
    before the next reads; the state that was committed last."""
    from ..sinks import commands
    from ..sinks.store import CatalogStore
    b = Binding.of(spark, sf_dir)
    store = CatalogStore(spark, scratch_path(spark, "store"))
    full = b.catalog()
    store.create(Catalog(**{t: getattr(full, t) for t in ("brand", "base_item", "site_user", "closet", "closet_item")}))
    commands.add_closets(store, rq.closet_adds(b.t), _as_of())
    commands.add_items_to_closets(store, rq.closet_item_adds(b.t), _as_of())
    commands.remove_closets(store, rq.closet_removes(b.t))
    commands.delete_rows(store, "site_user", rq.user_deletes(b.t))
    now = store.load()
    return now.closet.select("closet_id", "site_user_id", "name").join(users.closet_item_counts(now.closet, now.closet_item), "closet_id")


@query("closet_item_counts")
def _closet_item_counts(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return users.closet_item_counts(b.closet, b.closet_item)


# -- integrity, summaries (U39, D1, D3) ------------------------------------------
@query("delete_base_items")
def _delete_base_items(spark, sf_dir):
    """Status per requested id, against the whole ledger, and how many rows of
    each kind its deletion takes along."""
    b = Binding.of(spark, sf_dir)
    d = integrity.delete_rows(b.catalog().with_(ledger=b.stock_event), "base_item", rq.delete_requests(b.t))
    return d.counts(n_images="base_item_image", n_tags="tag_item", n_skus="sku", n_closet_entries="closet_item").drop("refused_by")


@query("delete_draft_items")
def _delete_draft_items(spark, sf_dir):
    """The same beside items that suppliers have announced: those have no stock
    events yet, so they go with all their rows."""
    b = Binding.of(spark, sf_dir)
    d = integrity.delete_rows(b.with_drafts().with_(ledger=b.stock_event), "base_item", rq.delete_requests_with_drafts(b.t))
    return d.counts(n_images="base_item_image", n_tags="tag_item", n_skus="sku", n_closet_entries="closet_item")


@query("delete_images")
def _delete_images(spark, sf_dir):
    """Images go with their links; an item's thumbnail is refused."""
    b = Binding.of(spark, sf_dir)
    d = integrity.delete_rows(b.catalog(), "image", rq.delete_requests(b.t).withColumnRenamed("base_item_id", "image_id"))
    return d.counts(n_item_images="base_item_image")


@query("delete_tags")
def _delete_tags(spark, sf_dir):
    """Tags go with their links to items."""
    b = Binding.of(spark, sf_dir)
    d = integrity.delete_rows(b.catalog(), "tag", rq.tag_deletes(b.t))
    return d.counts(n_items="tag_item")


@query("delete_brands")
def _delete_brands(spark, sf_dir):
    """A brand that has items is refused."""
    b = Binding.of(spark, sf_dir)
    return integrity.delete_rows(b.catalog(), "brand", rq.brand_deletes(b.t)).status


@query("delete_users")
def _delete_users(spark, sf_dir):
    """Users go with their session, their closets and what is in those."""
    b = Binding.of(spark, sf_dir)
    state = b.catalog().with_(session=users.open_sessions(None, b.session_open))
    d = integrity.delete_rows(state, "site_user", rq.user_deletes(b.t))
    return d.counts(n_sessions="session", n_closets="closet", n_closet_entries="closet_item")


@query("rating_buckets")
def _rating_buckets(spark, sf_dir):
    return summaries.rating_buckets(Binding.of(spark, sf_dir).base_item)


@query("users_by_role")
def _users_by_role(spark, sf_dir):
    return summaries.users_by_role(Binding.of(spark, sf_dir).site_user)


# -- feed ingest (U21-U29, D2) ----------------------------------------------------
def _feed_docs(b: Binding):
    return feed.parse_documents(feed.feed_from_part(b.t, b.tag))


def _ingest(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return b, ingest.ingest_feed(b.catalog(), _feed_docs(b))


@query("parse_feed")
def _parse_feed(spark, sf_dir):
    return ingest.parse_feed(_feed_docs(Binding.of(spark, sf_dir)))


@query("insert_if_absent")
def _insert_if_absent(spark, sf_dir):
    from pyspark.sql import functions as F
    b = Binding.of(spark, sf_dir)
    docs = _feed_docs(b)
    tags = ingest.feed_tag_names(docs).select(F.col("website_text").alias("name"), "page", "ord")
    _t, new_tags = ingest.insert_if_absent(b.tag, "tag_id", tags, ["page", "ord"])
    vendors = ingest.feed_vendor_names(docs).select("name", "page", "handle")
    _b, new_brands = ingest.insert_if_absent(b.brand, "brand_id", vendors, ["page", "handle"])
    return (new_tags.select(F.lit("tag").alias("dim"), F.col("tag_id").alias("id"), "name")
            .unionByName(new_brands.select(F.lit("brand").alias("dim"), F.col("brand_id").alias("id"), "name")))


@query("feed_item_tags")
def _feed_item_tags(spark, sf_dir):
    return ingest.feed_item_tags(_feed_docs(Binding.of(spark, sf_dir))).select("feed_item_id", "tag_name")


@query("add_base_items")
def _add_base_items(spark, sf_dir):
    _b, r = _ingest(spark, sf_dir)
    return r.new_base_items.select("feed_item_id", "base_item_id", "name", "brand_id",
                                   "thumbnail_image_id", "rating")


@query("attach_images")
def _attach_images(spark, sf_dir):
    return _ingest(spark, sf_dir)[1].new_item_images


@query("attach_tags")
def _attach_tags(spark, sf_dir):
    return _ingest(spark, sf_dir)[1].new_item_tags


@query("add_skus")
def _add_skus(spark, sf_dir):
    return _ingest(spark, sf_dir)[1].new_skus


@query("opening_stock")
def _opening_stock(spark, sf_dir):
    return _ingest(spark, sf_dir)[1].opening_ledger


@query("ingest_feed")
def _ingest_feed(spark, sf_dir):
    return _ingest(spark, sf_dir)[1].rejects


@query("ingest_feed_again")
def _ingest_feed_again(spark, sf_dir):
    """A feed that comes again after two thirds of it were ingested: what is new,
    the same or changed, what repeats an id, and what cannot be read."""
    from pyspark.sql import functions as F
    b = Binding.of(spark, sf_dir)
    raw = written(feed.feed_from_part(b.t, b.tag), "feed")
    first = ingest.ingest_feed(b.catalog(), feed.parse_documents(raw.filter(F.col("page_id") % 3 != 0)), dedupe=True)
    again = ingest.ingest_feed(first.catalog, feed.parse_documents(feed.feed_again(raw)), dedupe=True, known=written(first.feed_refs, "refs"))
    decided = again.decisions.select("feed_item_id", "decision")
    return decided.unionByName(again.rejects.filter(F.col("stage").isin("base_item", "document")).select(
        "feed_item_id", F.col("code").alias("decision")))


@query("feed_image_urls")
def _feed_image_urls(spark, sf_dir):
    return ingest.feed_image_urls(_feed_docs(Binding.of(spark, sf_dir)))


# -- streams (S1-S3): run to completion, read the sink back ------------------------
DEBOUNCE_GAP = "6 hours"      # events of one user lie hours apart in the log
DEBOUNCE_WATERMARK = "1 hour"
LOG_CUT, LATE_DELAY = "2024-01-20", "2 days"


@query("stream_stock_ledger")
def _stream_stock_ledger(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..streaming import runner
    b = Binding.of(spark, sf_dir)
    cut = F.col("transaction_date") < F.lit(LEDGER_CUT).cast("timestamp_ntz")
    waves = [b.stock_event.filter(cut), b.stock_event.filter(~cut)]
    ledger, _rejects = runner.run_ledger(spark, waves, b.sku, stock.BOUND_ORDER)
    return ledger


@query("stream_raw_stock_ledger")
def _stream_raw_stock_ledger(spark, sf_dir):
    """The stream over events as clients send them: ledger rows, and rejects with their status."""
    from pyspark.sql import functions as F
    from ..streaming import runner
    b = Binding.of(spark, sf_dir)
    raw = rq.raw_stock_events(b.stock_event)
    old = F.col("transaction_date") < _cut()
    ledger, rejects = runner.run_ledger(spark, [raw.filter(old), raw.filter(~old)], b.sku, stock.BOUND_ORDER)
    return ledger.withColumn("status", F.lit("ok")).unionByName(rejects, allowMissingColumns=True)


@query("stream_search_debounce")
def _stream_search_debounce(spark, sf_dir):
    from ..streaming import runner
    b = Binding.of(spark, sf_dir)
    return runner.run_debounce(spark, b.search_log, DEBOUNCE_GAP, DEBOUNCE_WATERMARK)


@query("stream_search_debounce_late")
def _stream_search_debounce_late(spark, sf_dir):
    """The log in two waves, some rows of the first one coming with the second:
    bursts, and the rows that came too late for theirs."""
    from pyspark.sql import functions as F
    from ..streaming import runner
    b = Binding.of(spark, sf_dir)
    early = F.col("ts") < _cut(LOG_CUT)
    held = F.col("event_id") % 20 == 3
    waves = [b.search_log.filter(early & ~held), b.search_log.filter(~early | held)]
    bursts, late = runner.run_debounce_late(spark, waves, DEBOUNCE_GAP, LATE_DELAY)
    late = late.select(F.lit("late").alias("kind"), "user_id", F.col("ts").alias("window_start"), F.lit(None).cast("timestamp_ntz").alias("window_end"),
                       F.col("query").alias("last_query"), F.lit(1).cast("long").alias("n_queries"))
    return bursts.select(F.lit("burst").alias("kind"), "*").unionByName(late)


@query("search_debounce")
def _search_debounce(spark, sf_dir):
    from ..streaming import debounce
    return debounce.debounce(Binding.of(spark, sf_dir).search_log, DEBOUNCE_GAP)


@query("stream_ingest")
def _stream_ingest(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..streaming import runner
    b = Binding.of(spark, sf_dir)
    raw = written(feed.feed_from_part(b.t, b.tag), "feed")  # read by the cut and both waves
    half = raw.agg(F.percentile_approx("page_id", 0.5)).first()[0]
    waves = [raw.filter(F.col("page_id") <= half), raw.filter(F.col("page_id") > half)]
    base = b.catalog()
    cat, ledger, rejects = runner.run_ingest(spark, base, waves)
    return ingest.added_items(base, cat, ledger).unionByName(rejects)


# -- browse, normalised: requests -> tag set, tag set -> items (no request x item rows)
@query("request_tagsets")
def _request_tagsets(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return browse.request_tagsets(rq.browse_requests(b.t), b.tag)


@query("match_tagsets")
def _match_tagsets(spark, sf_dir):
    b = Binding.of(spark, sf_dir)
    return browse.match_tagsets(browse.request_tagsets(rq.browse_requests(b.t), b.tag), b.catalog())
