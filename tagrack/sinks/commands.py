"""The commands of the shop on committed state: each loads the last version,
runs its operator and commits every table it changes, with its statuses, in one step.

``command`` names the batch: sent again, it answers from its own commit.
Each returns the statuses as committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ingest, integrity, users
from ..plans.materialize import written
from .store import CatalogStore


def _answer(store: CatalogStore, command: str | None, run) -> DataFrame:
    done = store.committed(command) if command is not None else None
    if done is None:
        inserts, deletes, results = run(store.load())
        done = store.commit(inserts, deletes, results, command)
    return store.results(done)


def insert_names(store: CatalogStore, table: str, names: DataFrame, order: list[str], command: str | None = None) -> DataFrame:
    """U22 for ``brand`` or ``tag``: the rows added, with their ids."""
    def run(cat):
        _all, new = ingest.insert_if_absent(getattr(cat, table), ingest.ID_COLUMNS[table], names, order)
        return {table: new}, {}, new
    return _answer(store, command, run)


def ingest_feed(store: CatalogStore, docs: DataFrame, command: str | None = None) -> DataFrame:
    """A feed's tags, brands, items, images, SKUs and opening stock at
    once; the answer holds the rejects."""
    def run(cat):
        r = ingest.ingest_feed(cat, docs)
        items = r.new_base_items.select(*[c for c in cat.base_item.columns if c in r.new_base_items.columns])
        inserts = {"tag": r.new_tags, "brand": r.new_brands, "image": r.new_images, "base_item": items,
                   "base_item_image": r.new_item_images, "tag_item": r.new_item_tags,
                   "sku": r.new_skus.select("item_id", "base_item_id", "basic_size")}
        if "ledger" in cat.names():
            inserts["ledger"] = r.opening_ledger.select(*[c for c in cat.ledger.columns if c in r.opening_ledger.columns])
        return inserts, {}, r.rejects
    return _answer(store, command, run)


def register_users(store: CatalogStore, signups: DataFrame, as_of, command: str | None = None) -> DataFrame:
    """New users and their first closets."""
    def run(cat):
        new, statuses = users.accepted_signups(cat.site_user, signups)
        return {"site_user": new, "closet": users.default_closets(new, cat.closet, as_of)}, {}, statuses
    return _answer(store, command, run)


def add_closets(store: CatalogStore, adds: DataFrame, as_of, command: str | None = None) -> DataFrame:
    """U34."""
    def run(cat):
        new, statuses = users.new_closets(cat.closet, cat.site_user, adds, as_of)
        return {"closet": new}, {}, statuses
    return _answer(store, command, run)


def remove_closets(store: CatalogStore, removes: DataFrame, command: str | None = None) -> DataFrame:
    """Closets and what is in them."""
    def run(cat):
        statuses = written(users.closet_removals(cat.closet, cat.site_user, removes), "removals")
        gone = statuses.where("status = 'ok'").select("closet_id")
        entries = cat.closet_item.join(gone, "closet_id", "left_semi")
        return {}, {"closet": gone, "closet_item": entries}, statuses
    return _answer(store, command, run)


def add_items_to_closets(store: CatalogStore, adds: DataFrame, as_of, command: str | None = None) -> DataFrame:
    """U36."""
    def run(cat):
        new, statuses = users.new_closet_items(cat.closet, cat.closet_item, cat.site_user, cat, adds, as_of)
        return {"closet_item": new}, {}, statuses
    return _answer(store, command, run)


def delete_rows(store: CatalogStore, table: str, ids: DataFrame, command: str | None = None) -> DataFrame:
    """U39 for any table of the foreign-key graph."""
    def run(cat):
        d = integrity.delete_rows(cat, table, ids)
        return {}, d.gone, d.status
    return _answer(store, command, run)
