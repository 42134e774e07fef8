"""Exact, near and embedding duplicates against brute force on small tables."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tagrack.llm import embed_dedup, exact_dedup, minhash
from tagrack.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, schema)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup_keeps_the_longest_then_the_smallest(spark):
    texts = [(5, "a b"), (3, "ab"), (9, "a  b"), (7, "a  b"), (1, None), (2, ""), (4, " \t\n"), (8, "ab c"), (6, "x" * 200_000)]
    got = rows(exact_dedup.exact_dedup(docs(spark, texts)))
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()} == {
        5: (7, 4, False), 3: (7, 4, False), 9: (7, 4, False), 7: (7, 4, True),
        1: (4, 3, False), 2: (4, 3, False), 4: (4, 3, True), 8: (8, 1, True), 6: (6, 1, True)}
    assert got[5]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert got[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()


def test_exact_dedup_against_brute_force_with_a_hot_text(spark):
    rng = random.Random(1)
    texts = [(i, "hot text" if i % 3 == 0 else " ".join(rng.choices("abcd", k=rng.randint(0, 5)))) for i in range(600)]
    by = {}
    for i, t in texts:
        by.setdefault(WS.sub("", t), []).append((-len(t), i))
    got = rows(exact_dedup.exact_dedup(docs(spark, texts)))
    for i, t in texts:
        group = by[WS.sub("", t)]
        assert (got[i]["keep_id"], got[i]["group_size"]) == (min(group)[1], len(group))
    kept = exact_dedup.drop_copies(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g)[1] for g in by.values())


def test_exact_dedup_repeated_rows_null_ids_and_empty_table(spark):
    texts = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    out = exact_dedup.exact_dedup(docs(spark, texts))
    assert sum(r["kept"] for r in out.collect()) == 2
    assert [(r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(docs(spark, texts)).orderBy("text").collect()] == [
        (1, "a"), (None, "b")]
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_bloom_passes_sure_uniques_by(spark):
    keys = exact_dedup.text_keys(docs(spark, [(i, f"text {i}") for i in range(500)] + [(900, "text 3")]))
    decided, _ = exact_dedup.decide(keys)
    by = {r["doc_id"]: r["possible"] for r in decided.collect()}
    assert by[3] and by[900] and sum(by.values()) < 60


def test_a_filter_beyond_the_broadcast_bound_gives_the_same(spark, monkeypatch):
    df = docs(spark, [(i, f"text {i % 40}") for i in range(60)] + [(None, "text 3"), (99, None)])
    want = rows(exact_dedup.exact_dedup(df)), sorted(map(str, exact_dedup.drop_copies(df).collect()))
    monkeypatch.setattr("tagrack.llm.common.BROADCAST_ROWS", -1)
    assert (rows(exact_dedup.exact_dedup(df)), sorted(map(str, exact_dedup.drop_copies(df).collect()))) == want


def test_clashing_column_names(spark):
    df = docs(spark, [(1, "a"), (2, "a")]).selectExpr("*", "1 as kept", "2 as h", "3 as _row", "4 as possible", "5 as uid", "6 as component_id")
    assert exact_dedup.drop_copies(df).columns == df.columns and exact_dedup.drop_copies(df).count() == 1
    assert minhash.keep_one_each(df).columns == df.columns


def shingles(text):
    w = [x for x in WS.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, share=85):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, base, n):
    """A tree of edits: every copy changes a few words of an earlier one."""
    out = [base]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(w)
    return out


def test_minhash_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(6):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        texts += [" ".join(w) for w in family(rng, base, 25)]
    texts += ["Same Words HERE", "same words here", "É one", "é one", "", None, "   ", "five words are here now", "a " * 40, "a " * 60]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)] + ["z" * 100_000]
    texts = list(enumerate(texts))
    want = brute(texts)
    got = rows(minhash.near_duplicates(docs(spark, texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    kept = minhash.keep_one_each(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_minhash_on_the_border_of_the_share(spark):
    # one changed word in the middle replaces five shingles
    for n, linked in ((66, True), (65, False), (60, False)):
        w = [f"w{i}" for i in range(n)]
        x = w[:n // 2] + ["other"] + w[n // 2 + 1:]
        s = n - 4
        assert (100 * (s - 5) >= 85 * (s + 5)) == linked
        got = rows(minhash.near_duplicates(docs(spark, [(1, " ".join(w)), (2, " ".join(x))])))
        assert (got[2]["component_id"] == 1) == linked


def test_minhash_empty_table_null_ids_and_repeated_rows(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    out = minhash.near_duplicates(docs(spark, [(3, t), (3, t), (None, t), (1, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out if r["doc_id"]) == [(1, 1, True), (3, 3, True)]
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]


def test_signature_is_circulant_and_estimates_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**62, 1000), rng.integers(0, 2**62, 1000)
    b[:800] = a[:800]
    sig = [minhash.signature(np.sort(x), 4096) for x in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.05
    assert (minhash.signature(np.sort(a), 384) == sig[0][:384]).all()


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 200), (7, 6)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    out, base = [], rng.normal(size=(12, 16))
    for i in range(400):
        x = base[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.3])
        out.append((i, int(rng.integers(2)), [float(v) for v in x]))
    out += [(1000, 0, None), (1001, 0, [0.0] * 16), (1002, 0, [float("nan")] + [1.0] * 15), (1003, None, out[0][2]),
            (1004, 0, [None] + [1.0] * 15), (1005, 0, [float("inf")] + [1.0] * 15), (1006, 0, [1e300] * 16), (1007, 0, [1e-300] * 16),
            (1008, 0, [1.0] * 3), (1009, 0, [])]
    return out


def test_embeddings_against_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)  # many cells and many blocks
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").withColumnRenamed("x", "kept")
    got = rows(embed_dedup.embedding_links(df).withColumnRenamed("vec_id", "doc_id"))

    def sound(label, v):
        return label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    good = [(i, label, np.array(v) / max(map(abs, v))) for i, label, v in vectors if sound(label, v)]
    near = {i: set() for i, *_ in vectors}
    for k, (i, li, x) in enumerate(good):
        for j, lj, y in good[:k]:
            if li == lj and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                near[i].add(j), near[j].add(i)
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near[i]), min(seen), i == min(seen)), i


def test_embedding_cells_hold_little_at_a_time():
    rng = np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4_000)), pa.array(list(rng.normal(size=(4_000, 16)))), pa.array(np.zeros(4_000, np.int32))],
                                       ["id", "vector", "k"])
    centres = {(16, 0): embed_dedup._unit(rng.normal(size=(2_048, 16)))}
    run, sizes = embed_dedup._cells(centres, embed_dedup.REACH), []
    tracemalloc.start()
    for out in run(iter([batch])):
        sizes.append(out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # one array of all classes and centres takes 65 MB, and there were several
    assert max(sizes) <= embed_dedup.HELD // 16 and sum(sizes) > 4_000


def test_embeddings_without_neighbours_go_no_further(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 64))
    near = base[:40] + 0.01 * rng.normal(size=(40, 64))
    df = spark.createDataFrame([(i, i % 2 if i < 600 else (i - 600) % 2, [float(v) for v in x]) for i, x in enumerate(np.vstack([base, near]))],
                               "vec_id long, label int, embedding array<float>")
    kept, keep = {}, embed_dedup.written
    monkeypatch.setattr(embed_dedup, "written", lambda df, name: kept.setdefault((name, len(kept)), keep(df, name)))
    monkeypatch.setattr(embed_dedup, "SKETCH_CELL", 32)  # several sketch cells and blocks of guests
    monkeypatch.setattr(embed_dedup, "SKETCH_GUESTS", 2)
    got = rows(embed_dedup.embedding_links(df).withColumnRenamed("vec_id", "doc_id"))
    assert {i for i, r in got.items() if r["n_links"]} == {*range(40), *range(600, 640)}
    assert all(got[600 + i]["component_id"] == i for i in range(40))
    cells = next(df for (name, _), df in kept.items() if name == "cells")
    assert {r["id"] for r in cells.select("id").collect()} == {*range(40), *range(600, 640)}


def test_embeddings_across_sketch_cells_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 30))
    x = np.array([base[i % 30] + rng.normal(size=30) * rng.choice([0.03, 0.13, 0.16]) for i in range(900)]).astype(np.float32)
    monkeypatch.setattr(embed_dedup, "SKETCH_CELL", 40)
    df = spark.createDataFrame([(i, "a", [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, label string, embedding array<float>")
    got = rows(embed_dedup.embedding_links(df).withColumnRenamed("vec_id", "doc_id"))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert [got[i]["n_links"] for i in range(900)] == links.tolist() and 0 < links.min() + links.max()


def test_embeddings_empty_and_null_ids(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert embed_dedup.embedding_links(spark.createDataFrame([], schema)).count() == 0
    out = embed_dedup.embedding_links(spark.createDataFrame([(None, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0])], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in out) == [(0, 0, None), (1, 1, 1), (2, 1, 1)]


def test_minhash_one_id_on_several_texts_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base + " more"
    other = " ".join(f"v{i}" for i in range(200))
    texts = [(1, base), (2, other), (2, near), (3, other + " x"), (3, None), (None, base), (None, base), (4, None), (4, "")]
    got = rows(minhash.near_duplicates(docs(spark, texts)))
    assert sorted(map(str, got)) == ["1", "2", "3", "4", "None"]
    # document 2 has the set with the lesser id of its two, and is linked by that one alone
    mine = min([near, other], key=lambda t: minhash._set_id(minhash.shingle_hashes(t)))
    assert got[2]["component_id"] == (1 if mine == near else 2)
    assert got[3]["component_id"] == (2 if mine == other else 3) and got[3]["n_shingles"] == 197
    assert (got[4]["n_shingles"], got[4]["component_id"], got[4]["kept"]) == (0, 4, True)
    assert got[None]["component_id"] is None and got[None]["kept"]
    clash = docs(spark, [(1, base), (2, base), (3, other)]).selectExpr("*", "7 as _gone", "8 as _did", "9 as _row")
    kept = minhash.keep_one_each(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_minhash_hot_sets_and_blank_texts(spark):
    hot = " ".join(f"w{i}" for i in range(50))
    texts = [(i, hot) for i in range(0, 300)] + [(i, " ") for i in range(300, 500)] + [(i, f"{i} a b c d e f g") for i in range(500, 600)]
    got = rows(minhash.near_duplicates(docs(spark, texts)))
    assert all(got[i]["component_id"] == 0 for i in range(300)) and all(got[i]["component_id"] == i for i in range(300, 600))
    assert sum(r["kept"] for r in got.values()) == 301
