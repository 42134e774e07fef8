"""Referential actions on delete (U39), walked along a declared foreign-key graph.

Deleting rows of one table takes along what its foreign keys say: ``cascade``
removes the child rows (and theirs in turn, to a fixed point), ``restrict``
refuses a row whose children exist, ``no_action`` refuses it unless the same
deletion removes those children too. Every step is one equi-join per edge on
``(root, key)`` rows; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..plans.materialize import materialize


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str  # cascade, restrict or no_action

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


# --- fixed values: keys and foreign keys of the shop's schema ---------------
PRIMARY_KEYS = {
    "brand": ["brand_id"], "tag": ["tag_id"], "image": ["image_id"], "base_item": ["base_item_id"],
    "base_item_image": ["base_item_id", "image_id"], "tag_item": ["tag_id", "base_item_id"], "sku": ["item_id"],
    "site_user": ["site_user_id"], "session": ["session_id"], "closet": ["closet_id"], "closet_item": ["closet_id", "item_id"],
}
FOREIGN_KEYS = (
    ForeignKey("base_item", "brand_id", "brand", "no_action"),
    ForeignKey("base_item", "thumbnail_image_id", "image", "no_action"),
    ForeignKey("base_item_image", "base_item_id", "base_item", "cascade"),
    ForeignKey("base_item_image", "image_id", "image", "cascade"),
    ForeignKey("tag_item", "tag_id", "tag", "cascade"),
    ForeignKey("tag_item", "base_item_id", "base_item", "cascade"),
    ForeignKey("sku", "base_item_id", "base_item", "cascade"),
    ForeignKey("ledger", "item_id", "sku", "restrict"),
    ForeignKey("session", "site_user_id", "site_user", "cascade"),
    ForeignKey("closet", "site_user_id", "site_user", "cascade"),
    ForeignKey("closet_item", "closet_id", "closet", "cascade"),
    ForeignKey("closet_item", "item_id", "base_item", "cascade"),
)
# ------------------------------------------------------------------------------


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class Deletion:
    """What deleting rows of ``table`` does.

    ``status`` (id, status, refused_by): ok, missing or restricted with the
    foreign key that refuses (the first by name). ``gone``: per table the keys of
    the removed rows with the ``root`` id that took them along.
    """
    before: Catalog
    table: str
    status: DataFrame
    gone: dict[str, DataFrame]

    @property
    def catalog(self) -> Catalog:
        """The catalogue without the removed rows. Unchanged tables stay as they are."""
        return self.before.with_(**self.changed())

    def changed(self) -> dict[str, DataFrame]:
        return {t: getattr(self.before, t).join(rows.select(*PRIMARY_KEYS[t]).distinct(), PRIMARY_KEYS[t], "left_anti").select(
            *getattr(self.before, t).columns) for t, rows in self.gone.items()}

    def counts(self, **names: str) -> DataFrame:
        """``status`` with the number of rows that go along per table, named by
        ``column=table``; 0 for ids that stay or are missing."""
        out = self.status
        key = PRIMARY_KEYS[self.table][0]
        for column, table in names.items():
            n = self.gone[table].groupBy(F.col("root").alias(key)).agg(F.count(F.lit(1)).alias(column))
            out = out.join(n, key, "left").withColumn(column, F.coalesce(column, F.lit(0)).cast("long"))
        return out


def delete_rows(catalog: Catalog, table: str, ids: DataFrame, graph: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> Deletion:
    """Delete the rows of ``table`` named by ``ids`` (its key column).

    Each id is judged against the state before the batch, and a refused id takes
    nothing along. Null ids are ignored, repeated ones count once. Tables that
    the catalogue does not have are left out of the walk. The walk follows
    cascade edges from table to table; a table that is reached again (a cycle
    of keys) goes on with its new rows only, until there are none.
    """
    key = PRIMARY_KEYS[table][0]
    have = set(catalog.names())
    graph = tuple(e for e in graph if e.child in have and e.parent in have)
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    exists = materialize(asked.join(getattr(catalog, table).select(key).distinct(), key, "left_semi"))

    doomed: dict[str, list[DataFrame]] = {table: [exists.select(F.col(key).alias("root"), key)]}
    fresh = {table: doomed[table][0]}
    while fresh:
        found: dict[str, list[DataFrame]] = {}
        for e in graph:
            if e.on_delete == "cascade" and e.parent in fresh:
                found.setdefault(e.child, []).append(_children(catalog, e, fresh[e.parent], PRIMARY_KEYS[e.child]))
        fresh = {}
        for child, parts in found.items():
            rows = _union(parts).distinct() if len(parts) > 1 or child in doomed else parts[0]
            if child in doomed:
                rows = rows.join(_union(doomed[child]), ["root", *PRIMARY_KEYS[child]], "left_anti")
                rows = materialize(rows)
                if rows.isEmpty():
                    continue
            doomed.setdefault(child, []).append(rows)
            fresh[child] = rows
    removed = {t: _union(parts) for t, parts in doomed.items()}

    refusals = []
    for e in graph:
        if e.on_delete != "cascade" and e.parent in removed:
            held = _children(catalog, e, removed[e.parent], PRIMARY_KEYS.get(e.child, []))
            if e.on_delete == "no_action" and e.child in removed:
                held = held.join(removed[e.child], ["root", *PRIMARY_KEYS[e.child]], "left_anti")
            refusals.append(held.select("root", F.lit(e.name).alias("refused_by")))
    kind = getattr(catalog, table).schema[key].dataType
    refused = (_union(refusals).groupBy("root").agg(F.min("refused_by").alias("refused_by")) if refusals
               else exists.select(F.col(key).alias("root"), F.lit(None).cast("string").alias("refused_by")).where(F.lit(False)))
    judged = materialize(exists.select(F.col(key).alias("root")).join(refused, "root", "left"))
    status = asked.join(judged.select(F.col("root").cast(kind).alias(key), "refused_by", F.lit(True).alias("_e")), key, "left").select(
        key, F.when(F.col("_e").isNull(), "missing").when(F.col("refused_by").isNotNull(), "restricted").otherwise("ok").alias("status"),
        "refused_by")
    free = judged.where(F.col("refused_by").isNull()).select("root")
    return Deletion(catalog, table, status, {t: rows.join(free, "root", "left_semi") for t, rows in removed.items()})


def _children(catalog: Catalog, edge: ForeignKey, parents: DataFrame, key: list[str]) -> DataFrame:
    """(root, key of the child) of the rows that refer to ``parents`` (root, key of the parent)."""
    named = parents.select("root", F.col(PRIMARY_KEYS[edge.parent][0]).alias("_parent"))
    return (getattr(catalog, edge.child).select(*dict.fromkeys([edge.column, *key])).join(named, F.col(edge.column) == F.col("_parent"))
            .select("root", *key))


def delete_base_items(catalog: Catalog, ledger: DataFrame, ids: DataFrame) -> tuple[Catalog, DataFrame]:
    """U39 for base items: (new catalogue, status per id)."""
    d = delete_rows(catalog.with_(ledger=ledger), "base_item", ids)
    return d.catalog, d.status.select("base_item_id", "status")
