"""Committed commands: all tables of a command change at once or not at all."""

import pytest
from pyspark.sql import functions as F

from fixtures import rows
from tagrack.model import Catalog
from tagrack.sinks import commands
from tagrack.sinks.store import CatalogStore

AS_OF = "2024-01-01 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    make = spark.createDataFrame
    cat = Catalog(
        brand=make([(1, "Acme", "acme")], "brand_id long, name string, name_key string"),
        tag=make([(1, "red", "red")], "tag_id long, name string, name_key string"),
        base_item=make([(1, "Coat", "coat", 1, None), (2, "Hat", "hat", 1, None)],
                       "base_item_id long, name string, name_key string, brand_id long, thumbnail_image_id long"),
        site_user=make([(1, "A", "B", "ann", "a@x.org", False, False), (2, "C", "D", "bob", "b@x.org", False, False)],
                       "site_user_id long, first_name string, last_name string, username string, email string, is_staff boolean, is_admin boolean"),
        closet=make([(1, 1, "Summer"), (2, 2, "Work")], "closet_id long, site_user_id long, name string").withColumn(
            "created_at", F.lit(AS_OF).cast("timestamp_ntz")),
        closet_item=make([(1, 1), (2, 2)], "closet_id long, item_id long").withColumn("added_at", F.lit(AS_OF).cast("timestamp_ntz")))
    store = CatalogStore(spark, str(tmp_path / "shop"))
    assert store.create(cat) == 1
    return store


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def state(store):
    cat = store.load()
    return rows(cat.closet, "closet_id", "site_user_id", "name"), rows(cat.closet_item, "closet_id", "item_id")


def adds(spark, *r):
    return spark.createDataFrame(list(r), "seq long, username string, closet_name string")


def test_commands_see_what_earlier_ones_committed(spark, store):
    got = commands.add_closets(store, adds(spark, (1, "ann", "Winter"), (2, "ann", "Winter"), (3, "eve", "x")), now())
    assert rows(got, "seq", "status", "closet_id") == [(1, "ok", 3), (2, "duplicate", None), (3, "unknown_user", None)]
    items = spark.createDataFrame([(1, "ann", "Winter", "HAT", "acme"), (2, "ann", "Summer", "coat", "acme"), (3, "ann", "Nope", "coat", "acme")],
                                  "seq long, username string, closet_name string, base_item_name string, brand_name string")
    got = commands.add_items_to_closets(store, items, now())
    assert rows(got, "seq", "status") == [(1, "ok"), (2, "already_present"), (3, "unknown_closet")]
    assert state(store) == ([(1, 1, "Summer"), (2, 2, "Work"), (3, 1, "Winter")], [(1, 1), (2, 2), (3, 2)])
    got = commands.remove_closets(store, adds(spark, (1, "ann", "Winter"), (2, "bob", "Winter")))
    assert rows(got, "seq", "status") == [(1, "ok"), (2, "unknown_closet")]
    assert state(store) == ([(1, 1, "Summer"), (2, 2, "Work")], [(1, 1), (2, 2)])
    # users go with their closets and entries
    assert rows(commands.delete_rows(store, "site_user", spark.createDataFrame([(2,)], "site_user_id long")), "status") == [("ok",)]
    assert state(store) == ([(1, 1, "Summer")], [(1, 1)])
    assert store.versions() == [1, 2, 3, 4, 5]
    # an older version is still there, as it was
    assert store.load(3).closet.count() == 3


def test_a_commit_killed_half_way_changes_nothing(spark, store, monkeypatch):
    before = state(store)
    write, done = CatalogStore._write_part, []

    def dies(self, table, version, part_rows):
        if len(done) == 1:
            raise KeyboardInterrupt  # the first table is written, the second is not
        done.append(table)
        return write(self, table, version, part_rows)
    monkeypatch.setattr(CatalogStore, "_write_part", dies)
    with pytest.raises(KeyboardInterrupt):
        commands.remove_closets(store, adds(spark, (1, "ann", "Summer")), command="r-1")
    monkeypatch.undo()
    assert done == ["closet"] and store.versions() == [1] and state(store) == before
    # sent again, it goes through; a third time it only answers
    for _ in range(2):
        assert rows(commands.remove_closets(store, adds(spark, (1, "ann", "Summer")), command="r-1"), "seq", "status") == [(1, "ok")]
    assert store.versions() == [1, 2] and state(store) == ([(2, 2, "Work")], [(2, 2)])
    # expiry takes the dead commit's part along, and nothing that is named
    removed = store.expire(keep=1)
    assert sum(p.startswith("closet/") for p in removed) == 2
    assert store.versions() == [2] and state(store) == ([(2, 2, "Work")], [(2, 2)])


def test_a_commit_that_dies_before_its_mark(spark, store, monkeypatch, tmp_path):
    (tmp_path / "shop/commits/version=2/_temporary").mkdir(parents=True)  # what a dead mark leaves
    assert store.versions() == [1]
    commands.add_closets(store, adds(spark, (1, "bob", "Gym")), now())
    assert store.versions() == [1, 2] and len(state(store)[0]) == 3


def test_deletes_rewrite_only_parts_that_hold_a_row(spark, store):
    commands.add_closets(store, adds(spark, (1, "ann", "Winter")), now())
    old = store.parts()["closet"]
    assert len(old) == 2
    commands.remove_closets(store, adds(spark, (1, "ann", "Winter")))
    new = store.parts()["closet"]
    assert len(new) == 2 and len(set(old) & set(new)) == 1
    before = store.parts()
    commands.remove_closets(store, adds(spark, (1, "eve", "Winter")))
    assert {t: p for t, p in store.parts().items() if t != "results"} == {t: p for t, p in before.items() if t != "results"}


def test_names_and_sign_ups(spark, store):
    names = spark.createDataFrame([("RED", 1), ("Blue", 2), ("blue", 3)], "name string, seq long")
    assert rows(commands.insert_names(store, "tag", names, ["seq"]), "tag_id", "name") == [(2, "Blue")]
    signups = spark.createDataFrame([(1, "E", "F", "eve", "e@x.org"), (2, "E", "F", "ann", "n@x.org")],
                                    "seq long, first_name string, last_name string, username string, email string")
    got = commands.register_users(store, signups, now())
    assert rows(got, "seq", "status") == [(1, "ok"), (2, "username_taken")]
    cat = store.load()
    assert rows(cat.closet.where("name = 'Favorites'"), "site_user_id") == [(3,)] and cat.tag.count() == 2


def test_create_twice_and_unknown_tables_are_refused(spark, store):
    with pytest.raises(ValueError):
        store.create(store.load())
    with pytest.raises(ValueError):
        store.commit(inserts={"nope": spark.range(1)})
    with pytest.raises(TypeError):
        Catalog(nope=spark.range(1))
