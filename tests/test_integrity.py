"""Deletes along the foreign-key graph, against a plain walk over Python rows."""

import random

import pytest

from fixtures import rows
from tagrack.model import Catalog
from tagrack.operators.integrity import FOREIGN_KEYS, PRIMARY_KEYS, ForeignKey, delete_rows

SCHEMAS = {
    "brand": "brand_id long, name string", "tag": "tag_id long, name string", "image": "image_id long, url string",
    "base_item": "base_item_id long, name string, brand_id long, thumbnail_image_id long",
    "base_item_image": "base_item_id long, image_id long", "tag_item": "tag_id long, base_item_id long",
    "sku": "item_id long, base_item_id long, basic_size string", "ledger": "item_id long, delta_quantity long",
    "site_user": "site_user_id long, username string", "session": "session_id long, site_user_id long",
    "closet": "closet_id long, site_user_id long, name string", "closet_item": "closet_id long, item_id long",
}


def shop(seed):
    rng = random.Random(seed)
    some = lambda n: rng.randint(1, n)
    t = {"brand": [(i, f"b{i}") for i in range(1, 6)], "tag": [(i, f"t{i}") for i in range(1, 8)],
         "image": [(i, f"i{i}") for i in range(1, 13)]}
    t["base_item"] = [(i, f"n{i}", rng.choice([None, 1, 2, 3]), rng.choice([None, some(12)])) for i in range(1, 15)]
    t["base_item_image"] = sorted({(some(14), some(12)) for _ in range(20)})
    t["tag_item"] = sorted({(some(7), some(14)) for _ in range(20)})
    t["sku"] = [(100 + i, some(14), "S") for i in range(20)]
    t["ledger"] = [(100 + some(19), some(5)) for _ in range(9)]
    t["site_user"] = [(i, f"u{i}") for i in range(1, 6)]
    t["session"] = [(i, i) for i in (1, 3)]
    t["closet"] = [(i, some(5), f"c{i}") for i in range(1, 9)]
    t["closet_item"] = sorted({(some(8), some(14)) for _ in range(20)})
    return t


def columns(table):
    return [f.split()[0] for f in SCHEMAS[table].split(", ")]


def by_hand(tables, table, root, graph):
    """(status, refused_by, {table: set of keys}) of one deletion."""
    dicts = {t: [dict(zip(columns(t), r)) for r in rs] for t, rs in tables.items()}
    key = lambda t, r: tuple(r[c] for c in PRIMARY_KEYS[t])
    if root not in {r[PRIMARY_KEYS[table][0]] for r in dicts[table]}:
        return "missing", None, {}
    gone, todo = {(table, (root,))}, [(table, (root,))]
    while todo:
        t, k = todo.pop()
        for e in graph:
            if e.parent == t and e.on_delete == "cascade":
                for r in dicts[e.child]:
                    at = (e.child, key(e.child, r))
                    if r[e.column] == k[0] and at not in gone:
                        gone.add(at)
                        todo.append(at)
    refused = [e.name for e in graph if e.on_delete != "cascade" for r in dicts[e.child]
               if (e.parent, (r[e.column],)) in gone
               and not (e.on_delete == "no_action" and (e.child, key(e.child, r)) in gone)]
    if refused:
        return "restricted", min(refused), {}
    out = {}
    for t, k in gone:
        out.setdefault(t, set()).add(k)
    return "ok", None, out


@pytest.fixture(scope="module")
def data():
    return shop(5)


def catalog(spark, data):
    return Catalog(**{t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in data.items()})


@pytest.mark.parametrize("table", ["base_item", "image", "tag", "brand", "site_user", "closet"])
def test_every_table_against_a_walk_by_hand(spark, data, table):
    cat = catalog(spark, data)
    key = PRIMARY_KEYS[table][0]
    ids = [r[0] for r in data[table]] + [999, None, data[table][0][0]]
    d = delete_rows(cat, table, spark.createDataFrame([(i,) for i in ids], f"{key} long"))
    want = {i: by_hand(data, table, i, FOREIGN_KEYS) for i in ids if i is not None}
    assert {r[key]: (r["status"], r["refused_by"]) for r in d.status.collect()} == {i: w[:2] for i, w in want.items()}
    gone = {}
    for w in want.values():
        for t, keys in w[2].items():
            gone.setdefault(t, set()).update(keys)
    after = d.catalog
    for t, before in data.items():
        named = [columns(t).index(c) for c in PRIMARY_KEYS.get(t, [])]
        left = [r for r in before if tuple(r[i] for i in named) not in gone.get(t, set())] if named else before
        assert sorted(map(str, rows(getattr(after, t)))) == sorted(map(str, left)), t


def test_counts_per_deleted_row(spark, data):
    d = delete_rows(catalog(spark, data), "site_user", spark.createDataFrame([(i,) for i in (1, 2, 3, 77)], "site_user_id long"))
    got = {r["site_user_id"]: (r["status"], r["n_sessions"], r["n_closets"], r["n_entries"])
           for r in d.counts(n_sessions="session", n_closets="closet", n_entries="closet_item").collect()}
    for i in (1, 2, 3, 77):
        status, _by, gone = by_hand(data, "site_user", i, FOREIGN_KEYS)
        assert got[i] == (status, len(gone.get("session", ())), len(gone.get("closet", ())), len(gone.get("closet_item", ())))


def test_no_action_is_freed_by_the_same_cascade_and_restrict_is_not(spark):
    # closets as rows that refer to users and to each other's items; keys of the test's own
    graph = (ForeignKey("closet", "site_user_id", "site_user", "cascade"),
             ForeignKey("session", "site_user_id", "site_user", "no_action"))
    tables = {"site_user": [(1, "a"), (2, "b")], "closet": [(1, 1, "x")], "session": [(1, 2)]}
    cat = Catalog(**{t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in tables.items()})
    d = delete_rows(cat, "site_user", spark.createDataFrame([(1,), (2,)], "site_user_id long"), graph)
    assert rows(d.status) == [(1, "ok", None), (2, "restricted", "session.site_user_id")]
    both = (*graph, ForeignKey("session", "site_user_id", "site_user", "cascade"))
    d = delete_rows(cat, "site_user", spark.createDataFrame([(2,)], "site_user_id long"), both)
    assert rows(d.status) == [(2, "ok", None)] and d.catalog.session.count() == 0


def test_a_cycle_of_cascades_ends(spark):
    # users refer to closets and closets to users
    graph = (ForeignKey("closet", "site_user_id", "site_user", "cascade"), ForeignKey("site_user", "username", "closet", "cascade"))
    users = [(1, 10), (2, 11), (3, 12), (4, 99)]
    closets = [(10, 2, "x"), (11, 3, "y"), (12, 1, "z")]  # 1 -> closet 12 -> user 3 -> 11 -> 2 -> 10 -> 1
    cat = Catalog(site_user=spark.createDataFrame(users, "site_user_id long, username long"),
                  closet=spark.createDataFrame(closets, SCHEMAS["closet"]))
    d = delete_rows(cat, "site_user", spark.createDataFrame([(1,)], "site_user_id long"), graph)
    assert rows(d.catalog.site_user) == [(4, 99)] and d.catalog.closet.count() == 0


def test_missing_tables_and_empty_requests(spark, data):
    cat = Catalog(tag=spark.createDataFrame(data["tag"], SCHEMAS["tag"]))
    d = delete_rows(cat, "tag", spark.createDataFrame([(1,), (50,)], "tag_id long"))
    assert rows(d.status, "tag_id", "status") == [(1, "ok"), (50, "missing")]
    assert delete_rows(cat, "tag", spark.createDataFrame([], "tag_id long")).status.count() == 0
