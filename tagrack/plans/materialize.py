"""Materialise an intermediate that several branches of a plan read.

``checkpoint()`` writes the rows to the shared folder named by
``spark.checkpoint.dir`` and returns a DataFrame reading them: every later
branch reads the written rows instead of recomputing the lineage, and a lost
executor costs a re-read, not a recomputation from the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir, scratch_path


def materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Columnar and compressed, so much smaller than ``checkpoint()``'s rows, and
    the reader keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
