"""Every query of the library against its DuckDB twin on sf0.001, plus plan checks.

The optional training-data queries, which partly run Python and cannot all be
said in SQL, have tests of their own in ``tests/llm``.
"""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck
from tagrack.plans.checks import PYTHON_NODES, plan_text
from tagrack.plans.oracle import SQL
from tagrack.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
BATCH = [k for k in QUERIES if not k.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)
    assert set(E.queries()) >= set(QUERIES) and set(E.oracle_sql()) >= set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle_and_stays_in_the_jvm(spark, con, name):
    df = E.queries()[name](spark, SF)
    if name in BATCH:
        text = plan_text(df)
        assert not [n for n in PYTHON_NODES if n in text]
    ok, msg = compare(df, con, E.oracle_sql()[name])
    assert ok, msg


@pytest.mark.parametrize("name", ["similar_items", "more_from_brand", "search_names"])
def test_top_k_plans_limit_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_text(E.queries()[name](spark, SF))


def test_scans_are_pruned(spark):
    text = plan_text(E.queries()["validate_stock_events"](spark, SF))
    scan = [ln for ln in text.splitlines() if ln.strip().startswith("ReadSchema")]
    assert scan and all("l_tax" not in ln and "l_discount" not in ln for ln in scan)


def test_size_dimension_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan_text(E.queries()["size_availability"](spark, SF))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["request_id", "rank", "item_name", "brand_name", "thumbnail_url",
                          "shared_tag_count"]
    assert df.count() > 0
