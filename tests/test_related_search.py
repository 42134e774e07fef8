import pytest

from fixtures import catalog, rows
from tagrack.model import SEED_SCHEMA
from tagrack.operators import related, search


@pytest.fixture(scope="module")
def cat(spark):
    # tags a(1) b(2) c(3); seed item 1 has a,b,c
    return catalog(
        spark,
        brands=[(1, "Acme"), (2, "Ñandú"), (3, "9 Lives"), (4, "&Co"), (5, "élan")],
        items=[(1, "Seed", 1, None, 1.0), (2, "beta", 1, 2, 1.0), (3, "Alpha", 2, None, 1.0),
               (4, "alpha", None, None, 1.0), (5, "gamma", 1, None, 1.0), (6, "SEED", 1, None, 1.0),
               (7, "delta", 1, None, 1.0), (8, "café crème", 2, None, 1.0)],
        tags=[(1, "a"), (2, "b"), (3, "c"), (4, "Étoile")],
        # item -> tags: 1 {a,b,c,É} 2 {a,b,É} 3 {a,b,c,É} 4 {a,É} 5 {b,É} 6,7,8 {É}
        item_tags=[(t, i) for i, ts in {1: [1, 2, 3, 4], 2: [1, 2, 4], 3: [1, 2, 3, 4], 4: [1, 4],
                                        5: [2, 4], 6: [4], 7: [4], 8: [4]}.items() for t in ts],
        images=[(2, "b.jpg")])


def seeds(spark, *rs):
    return spark.createDataFrame(list(rs), SEED_SCHEMA)


def test_similar_scores_ties_and_limits(spark, cat):
    s = seeds(spark, (1, "seed", "ACME", 3), (2, "nope", "Acme", 4), (3, "seed", "Acme", None),
              (4, "seed", "Acme", -2), (5, "beta", "acme", 1))
    got = rows(related.similar_items(s, cat), "request_id", "rank", "item_name", "shared_tag_count")
    # seed 1 tags a,b,c,Étoile; item 3 shares 4, item 2 shares 3 (a,b,Étoile), item 6 (SEED, a namesake) 2...
    assert got == [(1, 1, "Alpha", 4), (1, 2, "beta", 3), (1, 3, "alpha", 2), (5, 1, "Alpha", 3)]


def test_similar_excludes_the_seed_only(spark, cat):
    s = seeds(spark, (1, "seed", "acme", 10))
    names = [r[0] for r in rows(related.similar_items(s, cat), "item_name")]
    assert "Seed" not in names and "SEED" in names


def test_more_from_brand_drops_all_namesakes(spark, cat):
    s = seeds(spark, (1, "SEED", "acme", 4), (2, "x", None, 4), (3, "beta", "ACME", 2))
    got = rows(related.more_from_brand(s, cat), "request_id", "rank", "item_name", "thumbnail_url")
    assert got == [(1, 1, "beta", "b.jpg"), (1, 2, "delta", None), (1, 3, "gamma", None),
                   (3, 1, "delta", None), (3, 2, "gamma", None)]


def test_more_like_has_both_lists(spark, cat):
    s = seeds(spark, (1, "seed", "acme", 1))
    got = rows(related.more_like(s, cat), "kind", "rank", "item_name")
    assert got == [("more_from_brand", 1, "beta"), ("similar_items", 1, "Alpha")]


def q(spark, *rs):
    return spark.createDataFrame(list(rs), "query_id long, q string")


def test_search_accents_prefix_wildcards(spark, cat):
    got = rows(search.search_names(q(spark, (1, "ETO"), (2, "cafe"), (3, "a%a"), (4, None),
                                     (5, "n_n")), cat))
    assert (1, "tags", 1, "Étoile") in got
    assert (2, "items", 1, "café crème") in got
    items3 = [r[3] for r in got if r[0] == 3 and r[1] == "items"]
    assert items3 == ["Alpha", "alpha", "gamma"]      # prefix hits first, then folded name
    assert not [r for r in got if r[0] == 4]
    assert [r[3] for r in got if r[0] == 5] == ["Ñandú"]


def test_search_empty_matches_first_five_and_keeps_duplicates(spark, cat):
    got = rows(search.search_names(q(spark, (1, "")), cat))
    items = [r[3] for r in got if r[1] == "items"]
    assert items == ["Alpha", "SEED", "Seed", "alpha", "beta"]
    assert len([r for r in got if r[1] == "brands"]) == 5


def test_normalize_queries(spark):
    got = rows(search.normalize_queries(q(spark, (1, "  ab "), (2, "   "), (3, None), (4, "x"))))
    assert got == [(1, "ab"), (4, "x")]


def test_brand_index(spark, cat):
    got = rows(search.brand_index(cat.brand), "initial", "rank", "name")
    assert got == [("#", 1, "9 Lives"), ("&", 1, "&Co"), ("A", 1, "Acme"), ("E", 1, "élan"),
                   ("N", 1, "Ñandú")]
    letters = rows(search.brand_index_letters(cat.brand), "letter_order", "initial", "n_brands", "rank", "name")
    assert len(letters) == 27 and letters[0] == (0, "A", 1, 1, "Acme") and letters[-1] == (26, "#", 1, 1, "9 Lives")
    assert letters[1] == (1, "B", 0, None, None)


def test_search_escapes_literals_and_wildcards_against_brute_force(spark):
    import re

    from fixtures import catalog
    names = ["acme", "ab%cd", "abc%", "a_c", "axc", "abc", "", "x", "%", "\\", "a\\c", "ABcab"]
    cat = catalog(spark, brands=list(enumerate(names, 1)), items=[], tags=[], images=[], skus=[])
    queries = ["a\\c", "ab\\%cd", "abc\\", "\\%", "\\_", "_", "__", "%%", "____________", "", "\\\\", "b", "c%a", "b_%d", "a\\", "zz", "\\"]

    def regex(p):
        out, i = "", 0
        while i < len(p):
            if p[i] == "\\":
                i += 1
                out += re.escape(p[i])
            else:
                out += {"%": ".*", "_": "."}.get(p[i], re.escape(p[i]))
            i += 1
        return re.compile(out, re.S | re.I)
    for literal in (False, True):
        got = rows(search.search_names(q(spark, *enumerate(queries)), cat, literal=literal))
        for i, text in enumerate(queries):
            p = re.sub(r"([\\%_])", r"\\\1", text) if literal else text
            hits = [(0 if regex(p + "%").fullmatch(n) else 1, n, k) for k, n in enumerate(names, 1) if regex("%" + p + "%").fullmatch(n)]
            assert [r[3] for r in got if r[0] == i] == [n for _, n, _ in sorted(hits)][:5], (literal, text)


def test_similar_hot_tag_split_is_exact(spark):
    import __spark_entry__ as E
    from oracle_harness import compare, duck
    from tagrack.operators import related as rel
    from tagrack.sources import requests as rq
    from tagrack.sources.binding import Binding
    sf = "/root/testdata/sf0.001"
    b = Binding(spark, sf)
    con = duck(sf)
    for share in (0.0, 0.02, 0.1, 1.0):   # all hot, some hot, few hot, none hot
        df = rel.similar_items(rq.seed_requests(b.t), b.catalog(), hot_share=share)
        ok, msg = compare(df, con, E.oracle_sql()["similar_items"])
        assert ok, (share, msg)


def test_kept_related_index_serves_shorter_lists_and_refuses_longer_ones(spark, cat, tmp_path):
    path = str(tmp_path / "index")
    s = seeds(spark, (1, "seed", "ACME", 3), (2, "nope", "Acme", 4), (3, "seed", "Acme", None), (4, None, None, 3), (5, "beta", "acme", 1))
    with pytest.raises(ValueError):
        related.RelatedIndex(spark, path)      # nothing there
    related.RelatedIndex.build(cat, 8, path=path)
    kept = related.RelatedIndex(spark, path)
    want = rows(related.similar_items(s, cat))
    assert want and rows(related.similar_items(s, cat, index=kept)) == want
    assert rows(related.more_like(s, cat, index=kept)) == rows(related.more_like(s, cat))
    known = spark.createDataFrame([(1, 1, 3), (5, 2, 1)], "request_id long, seed_id long, k int")
    assert rows(related.similar_items(s, cat, index=kept, resolved=known)) == want
    with pytest.raises(ValueError):
        related.similar_items(s, cat, 8, index=kept)


def test_related_index_of_an_empty_catalogue(spark, cat):
    none = catalog(spark, brands=[], items=[])
    kept = related.RelatedIndex.build(none, 4)
    assert [t.count() for t in (kept.signatures, kept.tags, kept.hot, kept.by_projection)] == [0, 0, 0, 0]
    assert rows(related.similar_items(seeds(spark, (1, "seed", "acme", 3)), none, index=kept)) == []


def test_kept_name_index_answers_like_the_catalogue_and_reads_what_is_asked(spark, tmp_path):
    import random

    from fixtures import catalog
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    items = [(i, f"{word()} {word()}", 1, None, None) for i in range(1, 150)]
    cat = catalog(spark, brands=[(i, word()) for i in range(1, 40)], items=items, tags=[(i, word()) for i in range(1, 30)], images=[], skus=[])
    names = search.searchable_names(cat)
    index = search.NameIndex(spark, str(tmp_path / "index"))
    assert index.extend(names.filter("kind <> 'items'")) == 1
    assert index.extend(names.filter("kind = 'items' AND name_id < 80")) == 2
    assert index.extend(names.filter("kind = 'items' AND name_id >= 80")) == 3
    queries = q(spark, *enumerate([word()[:rng.randint(1, 4)] for _ in range(40)] + ["", "%", "_", "a%b", "_____________", "zz", None, "é"]))
    for k in (5, 40):  # 40 is beyond the kept firsts
        assert rows(search.search_names(queries, None, k, index=index)) == rows(search.search_names(queries, cat, k))
    # a name that comes again is not posted again
    before = index._read("postings", "gram string").count()
    index.extend(spark.createDataFrame([("items", items[0][1], 999)], "kind string, name string, name_id long").withColumn(
        "fname", search.fold("name")))
    assert index._read("postings", "gram string").count() == before
    # one gram reads one division of each part
    one = index.postings(spark.createDataFrame([("abc",)], "gram string"))
    from pyspark.sql import functions as F

    from tagrack.plans.checks import plan_text
    assert "division" in plan_text(one).split("PartitionFilters:")[1].split("\n")[0]
    asked = index._asked("postings", "gram string", "gram", spark.createDataFrame([("a",)], "gram string"))
    files = {r[0] for r in asked.select(F.input_file_name()).collect()}
    assert len({f.split("division=")[1].split("/")[0] for f in files}) == 1


def test_texts_of_related_items_are_not_sent_through_the_driver(spark, cat):
    from tagrack.plans.checks import plan_text
    from tagrack.plans.materialize import written
    # small files, as Spark would send through the driver
    cat = cat.with_(**{t: written(getattr(cat, t), "small") for t in ("brand", "base_item", "image")})
    found = spark.createDataFrame([(1, 1, 2)], "request_id long, rank int, base_item_id long")
    shown = related._display(found, cat)
    assert rows(shown, "item_name", "brand_name", "thumbnail_url") == [("beta", "Acme", "b.jpg")]
    assert plan_text(shown, "simple").count("SortMergeJoin") == 2
    resolved = plan_text(related.resolve_seeds(seeds(spark, (1, "seed", "ACME", 3)), cat), "simple")
    assert resolved.count("SortMergeJoin") == 1
