"""S3: streaming feed ingest -- new feed files run the whole-table ingest.

Each micro-batch of documents is ingested against the catalogue as the
earlier batches left it. Deltas land under ``out/<table>/batch=<id>``
(overwrite), so a retried batch rewrites its own folder and never duplicates
rows. A mark under ``out/done`` follows the last table of a batch; readers see
marked batches only.

A batch reads no whole table. The mark holds the largest id of every numbered
table, so later batches number on from it; the base must not gain rows of its
own while a stream adds to it. Names and image URLs are looked up in
``out/lookup/<table>``, divided by a hash of the name or URL into ``DIVISIONS``
folders: written from the base by the first batch, added to by every batch,
and read in the divisions of a batch's own names only.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..model import Catalog
from ..operators import ingest
from ..plans.materialize import materialize
from ..sources.feed import parse_documents
from ..sources.tables import read_parquet_if_present

DELTAS = {
    "tag": ["tag_id", "name", "name_key"],
    "brand": ["brand_id", "name", "name_key"],
    "base_item": ["base_item_id", "name", "name_key", "description", "brand_id",
                  "thumbnail_image_id", "rating"],
    "image": ["image_id", "url"],
    "base_item_image": ["base_item_id", "image_id"],
    "tag_item": ["tag_id", "base_item_id"],
    "sku": ["item_id", "base_item_id", "basic_size"],
}


def feed_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Streaming DataFrame(doc, raw) over JSON-lines feed files (bounded files per
    micro-batch); lines are read as text, so a broken one becomes a reject."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_documents(lines.withColumnRenamed("value", "raw"))


def _delta_path(out: str, table: str) -> str:
    return os.path.join(out, table)


def read_state(spark: SparkSession, base: Catalog, out: str, before_batch: int | None = None
               ) -> tuple[Catalog, DataFrame | None, DataFrame | None]:
    """(catalogue = base + deltas so far, opening ledger rows, rejects).

    With ``before_batch`` only deltas of earlier batches count: a batch that
    is retried after a failure never sees what its own failed attempt wrote.
    Without it, those of batches written to the end.
    """
    if before_batch is None:
        done = read_parquet_if_present(spark, _delta_path(out, "done"))
        before_batch = 0 if done is None else done.agg(F.max("batch")).first()[0] + 1
    def delta(name: str) -> DataFrame | None:
        written = read_parquet_if_present(spark, _delta_path(out, name))
        if written is not None:
            written = written.filter(F.col("batch") < F.lit(before_batch))
        return written.drop("batch") if written is not None else None

    changes = {}
    for table, cols in DELTAS.items():
        cur = getattr(base, table)
        written = delta(table)
        if written is not None:
            cur = cur.unionByName(written.select(*cols), allowMissingColumns=True)
        changes[table] = cur
    return base.with_(**changes), delta("ledger"), delta("rejects")


# What a batch looks up, and by which column.
LOOKUPS = {"tag": "name_key", "brand": "name_key", "image": "url"}
DIVISIONS = 64
BASE = -1  # the batch number of what the base brings


def _division(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(DIVISIONS)).cast("int")


def _add_to_lookup(rows: DataFrame, out: str, table: str, batch_id: int) -> None:
    path = os.path.join(out, "lookup", table, f"batch={batch_id}")
    rows.select(*DELTAS[table]).withColumn("division", _division(LOOKUPS[table])).write.mode("overwrite").partitionBy("division").parquet(path)


def lookup(spark: SparkSession, out: str, table: str, keys: DataFrame, before_batch: int) -> DataFrame:
    """The rows of ``table`` that earlier batches and the base hold in the
    divisions of ``keys`` (one column)."""
    col = keys.columns[0]
    keys = keys.where(F.col(col).isNotNull())
    divisions = [r[0] for r in keys.select(_division(col).alias("d")).distinct().collect()]  # at most DIVISIONS numbers
    rows = spark.read.parquet(os.path.join(out, "lookup", table))
    return rows.filter((F.col("batch") < before_batch) & F.col("division").isin(divisions)).select(*DELTAS[table])


def batch_keys(docs: DataFrame) -> dict[str, DataFrame]:
    """The names and URLs that the documents of a batch mention, by lookup table."""
    items = ingest.feed_items(docs)
    names = ingest.feed_vendor_names(docs).select("name").unionByName(items.select(F.col("vendor").alias("name")))
    urls = items.select(F.explode(F.array_append("images", F.col("thumbnail_image"))).alias("url"))
    return {"tag": ingest.feed_tag_names(docs).select(name_key("website_text").alias("name_key")),
            "brand": names.select(name_key("name").alias("name_key")), "image": urls}


def read_tops(spark: SparkSession, out: str, before_batch: int) -> dict[str, int]:
    """Largest ids by table after the last whole batch before ``before_batch``;
    empty before the first."""
    done = read_parquet_if_present(spark, _delta_path(out, "done"))
    if done is None:
        return {}
    last = done.filter(F.col("batch") < before_batch).agg(
        F.max_by(F.struct(*ingest.ID_COLUMNS), "batch").alias("tops")).first()["tops"]
    return last.asDict() if last else {}


def ingest_batches(base: Catalog, out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tops = read_tops(spark, out, batch_id)
        if not tops:  # the first batch: what the base holds
            tops = {t: ingest.max_id(getattr(base, t), col) for t, col in ingest.ID_COLUMNS.items()}
            for table in LOOKUPS:
                _add_to_lookup(getattr(base, table), out, table, BASE)
        docs = materialize(batch)
        known = {t: lookup(spark, out, t, keys, batch_id) for t, keys in batch_keys(docs).items()}
        res = ingest.ingest_feed(base.with_(**known), docs, tops, materialized=True)
        part = f"batch={batch_id}"
        frames = {
            "tag": res.new_tags,
            "brand": res.new_brands,
            "base_item": res.new_base_items,
            "image": res.new_images,
            "base_item_image": res.new_item_images,
            "tag_item": res.new_item_tags,
            "sku": res.new_skus,
            "ledger": res.opening_ledger,
            "rejects": res.rejects,
        }
        for table, df in frames.items():
            path = os.path.join(_delta_path(out, table), part)
            rows = df.select(*DELTAS.get(table, df.columns))
            rows.write.mode("overwrite").parquet(path)
            if table in ingest.ID_COLUMNS:
                added = spark.read.schema(rows.schema).parquet(path)
                if table in LOOKUPS:
                    _add_to_lookup(added, out, table, batch_id)
                top = added.agg(F.max(ingest.ID_COLUMNS[table])).first()[0]
                tops[table] = tops[table] if top is None else top
        # last: the batch is whole
        mark = spark.range(1).select(*[F.lit(n).cast("long").alias(t) for t, n in tops.items()])
        mark.write.mode("overwrite").parquet(os.path.join(_delta_path(out, "done"), part))
    return write
