"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every normalised text to one 64-bit word of a blocked Bloom
filter and to two bits of it, and keeps the bits hit at least twice. Pass two
tests every row in one lookup: a row with a bit hit once is certainly unique
and passes straight through; only rows whose two bits were both hit twice are
shuffled and compared by SHA-256. A false positive costs a shuffled row, never
a wrong answer. A filter beyond the broadcast bound is looked up by a join.

Defined cases. Null text counts as empty, and all empty or all-blank texts
form one group. Of equal texts the row with most code points of the original
text stays, then the smallest doc_id (null ids last), then one of the repeated
rows. An empty table gives no rows. Extra columns are carried through; the
operator's own columns replace ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, text_or_empty, written

# Bits of the filter per row, at least: two bits each, so at most about 2 % of
# unique rows are shuffled needlessly.
BITS_PER_ROW = 16
DECISION = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), r"[\x20\x09-\x0D]+", "")


def _place(h: Column, words: int) -> tuple[Column, Column, Column]:
    """(word, one bit, another bit) of a hash."""
    draw = F.xxhash64(h, F.lit(2))
    one = F.pmod(draw, F.lit(64))
    other = F.pmod(one + 1 + F.pmod(F.shiftright(draw, 6), F.lit(63)), F.lit(64))
    return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(words)), one.cast("int"), other.cast("int")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def repeated_bits(hashes: DataFrame, rows: int) -> tuple[DataFrame, int, int]:
    """Pass one over column ``h``: (word, mask) table of the bits that at
    least two rows hit, its row count, and the number of words of the filter."""
    words = max(16, 1 << ((BITS_PER_ROW * max(rows, 1) - 1) // 64).bit_length())
    word, one, other = _place(F.col("h"), words)
    hit = hashes.select(word.alias("word"), F.explode(F.array(one, other)).alias("bit"))
    twice = hit.groupBy("word", "bit").count().where("count >= 2")
    masks = written(twice.groupBy("word").agg(F.bit_or(_bit(F.col("bit"))).alias("mask")), "bloom")
    return masks, masks.count(), words


def flag_possible(df: DataFrame, masks: DataFrame, n_masks: int, words: int) -> DataFrame:
    """Pass two: adds ``possible``, false only for rows that are surely unique."""
    word, one, other = _place(F.col("h"), words)
    side = broadcast_if(masks.select(F.col("word").alias("_w"), F.col("mask").alias("_m")), n_masks)
    both = _bit(one).bitwiseOR(_bit(other))
    joined = df.withColumn("_at", word).join(side, F.col("_at") == F.col("_w"), "left")
    return joined.withColumn("possible", F.coalesce(F.col("_m").bitwiseAND(both) == both, F.lit(False))).drop("_at", "_w", "_m")


def text_keys(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One narrow row per document: uid, doc_id, n, text_sha256, h; written, so
    whole texts are read once and ``uid`` is fixed."""
    norm = docs.select(F.col(id_col).alias("doc_id"), F.length(text_or_empty(text_col)).alias("n"),
                       normalised(text_col).alias("t"))
    return written(norm.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n",
                               F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("h")), "text_keys")


def decide(keys: DataFrame) -> tuple[DataFrame, tuple[DataFrame, int, int]]:
    """(keys + possible, keep_id, group_size, kept; the filter). Only possible repeats shuffle."""
    rows = keys.count()
    bloom = repeated_bits(keys, rows)
    flagged = flag_possible(keys, *bloom)
    maybe = flagged.where("possible")
    order = F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))
    groups = written(maybe.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"),
        F.min_by(F.struct(F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid")), order).alias("k")), "groups")
    cols = [*keys.columns, "possible"]
    groups = groups.select("text_sha256", "group_size", "k.keep_id", "k.keep_uid")
    # A text held by over 0.1 % of all rows is one of at most 1,000 such texts:
    # those join by broadcast, so no key of the shuffled join is hot.
    hot = F.col("group_size") * 1000 > rows
    joined = (maybe.join(F.broadcast(groups.where(hot).withColumnsRenamed(
        {"group_size": "hot_size", "keep_id": "hot_id", "keep_uid": "hot_uid"})), "text_sha256", "left"))
    big = joined.where("hot_size is not null").select(
        *cols, F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"),
        (F.col("uid") == F.col("hot_uid")).alias("kept"))
    small = joined.where("hot_size is null").select(cols).join(groups.where(~hot), "text_sha256").select(
        *cols, "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"))
    alone = flagged.where("not possible").select(
        *cols, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    return alone.unionByName(big).unionByName(small), bloom


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document, dropped ones too: doc_id, n, keep_id, group_size,
    kept, text_sha256."""
    out, _ = decide(text_keys(docs, text_col, id_col))
    return out.select("doc_id", "n", *DECISION)


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came.

    Surely unique rows pass without a shuffle; possible repeats meet the kept
    keys in a join, and repeated rows with one id are reduced to one.
    """
    decided, bloom = decide(text_keys(docs, text_col, id_col))
    keep = written(decided.where("kept and possible").select(
        F.col("doc_id").alias("_id"), F.col("n").alias("_n"), F.col("text_sha256").alias("_k")), "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_did"),
                       F.length(text_or_empty(text_col)).alias("_len"), normalised(text_col).alias("_t"))
    rows = flag_possible(rows.withColumn("h", F.xxhash64("_t")), *bloom)
    maybe = rows.where("possible").select("_row", "_did", "_len", F.sha2("_t", 256).alias("_sha"))
    # the id and length in the join key spread the rows of one hot text
    first = (maybe.join(keep, (F.col("_sha") == F.col("_k")) & F.col("_did").eqNullSafe(F.col("_id"))
                        & (F.col("_len") == F.col("_n")), "left_semi").dropDuplicates(["_sha"]))
    return rows.where("not possible").select("_row.*").unionByName(first.select("_row.*"))
