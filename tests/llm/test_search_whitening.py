"""Ranked search, M-tree search and whitening against brute force on small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagrack.llm import mtree, ranked_search, whitening

DOCS = "doc_id long, text string, term string, shard long"
VECTORS = "vec_id long, embedding array<float>, label int, q long, pivot int, x array<long>"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, w string")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1, [1]) for i, v in rows], VECTORS)


# ---- ranked search ----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best_by_force(documents, asked, k=10):
    held = [(i, Counter(words(t))) for i, t in documents if i is not None and words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in asked:
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, times in Counter(words(text)).items() if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_ranked_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "straße", "日本", "a1", "THE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    documents = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 200])))) for i in rng.sample(range(5000), 400)]
    documents += [(9000 + i, "w1 w2 the!") for i in range(30)] + [(9100, None), (9101, ""), (9102, "?! \t")]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(25)]
    asked += [(100, None), (101, ""), (102, "unknownword"), (103, "the THE The w1")]
    assert got(ranked_search.ranked(docs(spark, documents).repartition(3), items(spark, asked))) == best_by_force(documents, asked)


def test_ranked_search_shards_end_and_merge(spark, monkeypatch):
    rng = random.Random(4)
    documents = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 30)))) for i in range(200)]
    asked = [(1, "a b c"), (2, "h h")]
    full = ranked_search.Shard()
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 7)
    for i, t in documents[:7]:
        full.add(i, t.encode())
    assert full.full()
    # workers import the module afresh, so many partitions make the many shards
    assert got(ranked_search.ranked(docs(spark, documents).repartition(40), items(spark, asked))) == best_by_force(documents, asked)


def test_ranked_search_repeats_nulls_and_empty_tables(spark):
    documents = [(1, "cat dog"), (1, "cat"), (2, "cat"), (None, "cat cat"), (3, "bird " * 30_000)]
    out = got(ranked_search.ranked(docs(spark, documents), items(spark, [(5, "cat"), (5, "dog"), (None, "cat"), (6, "bird")])))
    assert [r[:3] for r in out] == [(5, 1, 1), (5, 2, 2), (5, 3, 1), (6, 1, 3)] or [r[:3] for r in out] == [(5, 1, 1), (5, 2, 1), (5, 3, 2), (6, 1, 3)]
    assert [r[1] for r in out if r[0] == 5] == [1, 2, 3]
    none = docs(spark, [])
    assert got(ranked_search.ranked(none, items(spark, [(1, "a")]))) == []
    assert got(ranked_search.ranked(docs(spark, [(1, "a"), (2, "b")]), items(spark, []))) == []


def test_posting_codec_round_trip():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 2**b, 50) for b in (1, 7, 8, 14, 15, 31, 62)])
    data, ends = ranked_search.pack(values)
    assert (ranked_search.unpack(data) == values).all() and ends[-1] == len(data)


def test_block_maxima_spare_decoding():
    rng = random.Random(5)
    shard = ranked_search.Shard()
    for i in range(6000):
        rare = " rare rare rare" if i in (40, 41, 42) else ""
        shard.add(i, ("common " * rng.randint(1, 3) + "x " * rng.randint(1, 40) + rare).encode())
    lists, own = shard.batches(0)
    total = own.column("total")[0].as_py()
    lengths = np.frombuffer(own.column("lasts")[0].as_py(), np.int64)
    norm = ranked_search.length_norm(lengths, 6000, total)
    rows = lists.to_pandas()
    found = {r.term: ranked_search.PostingList(r, norm, 6000, total) for r in rows.itertuples()}
    doc, _ = ranked_search.best_documents([(found["rare"], 5000), (found["common"], 1)], 6000, 3)
    assert sorted(doc) == [40, 41, 42]
    # only blocks that may still beat the third best were decoded
    assert len(found["common"].known) < len(found["common"].lasts) / 2


# ---- M-tree -----------------------------------------------------------------

def nearest_by_force(rows, step, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            e = [math.floor(256 * float(np.float32(x))) for x in v]
            whole[i] = min(whole.get(i, e), e)
    out = []
    for i, q in whole.items():
        if i % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole.items() if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_mtree_against_brute_force_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5, -0.25, 0.0, 1.0, 0.1, 0.2]) for i in range(300)]  # a group of copies
    rows += [(2000 + i, rng.standard_normal(3).tolist()) for i in range(60)]  # another length
    rows += [(3000, None), (3050, []), (3100, [float("nan")] * 6), (3150, [float("inf")] * 6), (3200, [None] * 6), (None, [1.0] * 6),
             (3250, [0.0] * 6), (3300, [1.0]), (50, [9.0] * 6), (50, [-9.0] * 6)]
    assert got(mtree.nearest(vectors(spark, rows), F.col("id") % 50 == 0)) == nearest_by_force(rows, 50)


def test_mtree_no_rows_and_large_entries(spark):
    assert got(mtree.nearest(vectors(spark, []), F.col("id") % 50 == 0)) == []
    assert got(mtree.nearest(vectors(spark, [(1, [1.0])]), F.col("id") % 50 == 0)) == []
    rows = [(i, [float(3_000_000 + i), -2_000_000.0, float(i)]) for i in range(120)] + [(200, [1e30, 0.0, 0.0])]
    assert got(mtree.nearest(vectors(spark, rows), F.col("id") % 50 == 0)) == nearest_by_force(rows[:-1], 50)


def test_mtree_pages_bounds_and_spared_products():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (40, 4))
    x = np.concatenate([c + rng.integers(-20, 20, (100, 4)) for c in centres]).astype(np.int64)
    pages = mtree.load(x)

    def rows_of(n):
        p = pages[n]
        return p["entries"] if p["leaf"] else np.concatenate([rows_of(e) for e in p["entries"]])
    assert sorted(rows_of(len(pages) - 1)) == list(range(len(x)))
    for n, p in enumerate(pages):
        assert len(p["entries"]) <= (mtree.PAGE if p["leaf"] else mtree.FAN)
        assert (mtree._far(x[rows_of(n)], x[p["centre"]]) <= p["reach"]).all()
        assert np.allclose(p["parent"], mtree._far(x[p["objects"]], x[p["centre"]]))
    ids = np.arange(len(x))
    table = mtree._load((4, 0, 0), pd.DataFrame({"first": ids, "vector": list(x), "ids": [[i] for i in ids]}))
    tree = mtree.Tree(table)
    for q in x[::500]:
        score = x @ q
        want = sorted(zip(score.tolist(), ids.tolist()), key=lambda r: (-r[0], r[1]))[:5]
        tree.computed = 0
        assert tree.search(q, 5, None) == want
        assert tree.computed < len(x) / 3
        assert tree.search(q, 5, want[2][0]) == [w for w in want if w[0] >= want[2][0]] or tree.search(q, 5, want[2][0])[:3] == want[:3]


# ---- whitening --------------------------------------------------------------

def whiten_by_force(rows, k):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows], object)
    n = len(x)
    y = x * n - x.sum(axis=0)
    c = y.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (y * y).sum(axis=1).tolist(), c @ u / np.sqrt(e), e / (c * c).sum() * n


@pytest.mark.parametrize("length", [3, 20])
def test_whitening_against_dense_eigenvectors(spark, length):
    rng = np.random.default_rng(length)
    data = (rng.standard_normal((300, length)) * np.linspace(0.05, 1, length)).tolist()
    odd = [(900, None), (901, []), (902, [float("nan")] * length), (903, [float("inf")] * length), (904, [None] * length), (905, [1.0])]
    out = whitening.whiten(vectors(spark, list(enumerate(data)) + odd)).toPandas().sort_values(["vec_id", "component"])
    k = min(8, length)
    deviation, want, explained = whiten_by_force(data, k)
    assert len(out) == 300 * k and set(out["n"]) == {300} and out["vec_id"].max() == 299
    assert out[out["component"] == 1]["deviation"].tolist() == deviation
    have = out["whitened"].to_numpy().reshape(300, k)
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-9
    assert np.allclose(out["explained"].to_numpy()[:k], explained, rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_whitening_of_few_equal_repeated_and_no_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25])])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    # two distinct rows, one id twice, one null: a single component
    out = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [1.5, 0.25]), (2, [1.5, 0.25])])).collect()
    assert len(out) == 4 and {r["component"] for r in out} == {1} and {abs(round(r["whitened"], 9)) for r in out} == {1.0}
    # far beyond doubles' whole numbers: exact deviations, null beyond a long
    big = [(i, [float(2**38 + 2**19 * i), 0.0]) for i in range(3)]
    rows = {r["vec_id"]: r for r in whitening.whiten(vectors(spark, big)).collect()}
    assert rows[1]["deviation"] == 0 and rows[0]["deviation"] == rows[2]["deviation"] == (3 * 2**29) ** 2
    huge = [(i, [float(2**39 * i - 2**39), 0.0]) for i in range(3)]
    rows = {r["vec_id"]: r for r in whitening.whiten(vectors(spark, huge)).collect()}
    assert rows[1]["deviation"] == 0 and rows[0]["deviation"] is None


def test_jacobi_davidson_close_eigenvalues_and_restarts():
    rng = np.random.default_rng(6)
    u = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    values = np.sort(np.concatenate([[5.0, 5.0 - 1e-6, 5.0 - 2e-6], np.linspace(1, 4, 147)]))[::-1]
    a = (u * values) @ u.T
    e, v = whitening.jacobi_davidson(lambda x: a @ x, 150, 8)
    assert np.abs(e - values[:8]).max() < 1e-12
    assert np.linalg.norm(a @ v - v * e, axis=0).max() < 1e-12 and np.abs(v.T @ v - np.eye(8)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 2))
    assert np.abs(a @ whitening.minres(lambda x: a @ x, b, 200, 1e-12) - b).max() < 1e-6
