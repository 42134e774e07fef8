"""Plan inspection through the public ``explain`` output."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapCoGroupsInPandas", "PythonUDF")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict[str, int]:
    """Counts of the nodes that matter at scale."""
    text = plan_text(df, "formatted")
    keys = ["Exchange", "SinglePartition", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
            "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit",
            "Window", "HashAggregate", "Scan parquet"] + list(PYTHON_NODES)
    return {k: text.count(k) for k in keys if text.count(k)}
