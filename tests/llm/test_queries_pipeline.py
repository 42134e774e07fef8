"""Registered queries at the smallest scale, and the pipeline against brute force."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from oracle_harness import compare, duck
from tagrack.llm import toxicity
from tagrack.llm.common import table
from tagrack.llm.oracle import SQL
from tagrack.llm.queries import QUERIES, bpe_vocabulary
from test_dedup import WS, brute


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same, said = compare(QUERIES[name](spark, sf_dir), duck(sf_dir), SQL[name])
    assert same, said


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_every_row(spark, sf_dir, name):
    key, source, each = {"op6": ("page_id", "pages", 1), "op13": ("vec_id", "embeddings", 8)}.get(name.split("_")[0], ("doc_id", "documents", 1))
    source = table(spark, sf_dir, source)
    out = QUERIES[name](spark, sf_dir)
    assert sorted(r[0] for r in out.select(key).collect()) == sorted([r[0] for r in source.select(key).collect()] * each)


def test_stages_are_those_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "source_mixing", "byte_bpe"]


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    clean = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["score"] < 0.5}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in clean}
    best = {}
    for i, t in texts.items():
        k = WS.sub("", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    texts = {i: texts[i] for _, i in best.values()}
    near = brute(sorted(texts.items()))
    kept = {i for i, (_, c) in near.items() if c == i}
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*docs.columns, "ids"]
    rows = got.collect()
    # no document falls away in mixing, and some are repeated
    n = Counter(r["doc_id"] for r in rows)
    assert set(n) == kept and max(n.values()) >= 2
    from tagrack.llm import bpe
    codec = bpe.codec(*bpe_vocabulary())
    assert all(codec.decode(r["ids"]) == r["text"].encode() for r in rows)


def test_every_stage_keeps_the_columns_and_handles_odd_rows(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    names = [f.name for f in schema]
    odd = [{n: None for n in names}, dict.fromkeys(names) | {"doc_id": -1, "text": ""}, dict.fromkeys(names) | {"doc_id": -2, "text": "y " * 60_000},
           dict.fromkeys(names) | {"doc_id": -3, "text": "same text here"}, dict.fromkeys(names) | {"doc_id": -3, "text": "same text here"}]
    df = spark.createDataFrame([tuple(x[n] for n in names) for x in odd], schema)
    for rows in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            assert out.columns[:len(names)] == names, name
            assert (out.count() == 0) == (rows.count() == 0), name
