"""Joins whose sides grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both, whatever their sizes seem to be.

    Spark guesses the size of a scan from its compressed files and sends what seems
    small to every task by way of the driver. Well-compressed tables of millions of
    rows pass for small, so tables that grow with the data say it here.
    """
    return df.hint("merge")
