"""Near duplicates by circulant MinHash, banding and exact Jaccard.

Two permutations give all signature coordinates. The first scatters hashed
shingles over a ring of ``RING`` places; the second gives every place a rank,
and coordinate k of a signature is the least rank at (place + k) on the ring,
i.e. the second permutation shifted by k. The first ``BANDS * WIDTH``
coordinates are banded; one bit of every coordinate is kept as a sketch.

Links are confirmed on whole shingle sets: 64-bit hashes of five lower-cased
words, 100 * |A n B| >= 85 * |A u B|. Documents with one and the same set form
a class first, and only class representatives are compared. Inside a bucket
no pairs are expanded: members meet the bucket's centres, confirmed links are
contracted to components, and only members that the centres left outside the
bucket's main component meet the rest of the bucket.

Defined cases. Null, empty and blank texts have the empty set and link with
nothing; with fewer than five words the whole sequence is the one shingle;
rows of one id are one document, and where their texts differ its set is the one
of the least set id (a hash of the set; the empty set only if all are empty); rows
with a null id come back unlinked with a null component, one for each set. An empty table gives no rows. Extra
columns are ignored by ``near_duplicates``.

A pair at Jaccard 0.85 misses all bands with probability (1-0.85^6)^32 < 3e-7,
and fails a sketch test with probability below 1e-6. The sketches only decide
what is compared on whole sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, small_batches, written
from .components import components

RING = 1 << 20
BANDS, WIDTH = 32, 6
COORDINATES = 384
SKETCH_WORDS = COORDINATES // 64
# Differing sketch bits of a pair at Jaccard 0.85: 28.8 on average, 5.2 standard
# deviations of 5.16 above it is 55.6.
MOST_DIFFERENT = 56
# The fine sketch: 307.2 bits differ on average, 5 deviations of 16.9 above is 391.5.
FINE = 4096
MOST_DIFFERENT_FINE = 392
SHARE = 85
SHINGLE = 5
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Words between the ASCII white space of the contract, A-Z lower-cased."""
    return [w for w in _SPACE.split((text or "").translate(_UPPER)) if w]


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))], np.uint64).view(np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    n = len(h) - SHINGLE + 1
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):  # polynomial over word hashes, mixed after every word
            mixed = (mixed ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


@lru_cache(1)
def _ranks() -> np.ndarray:
    """The second permutation, continued so that every window of the ring is contiguous."""
    ranks = np.random.default_rng(20240229).permutation(RING).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:FINE]]), FINE)


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The first coordinates of a non-empty set; long sets are folded in blocks."""
    with np.errstate(over="ignore"):
        places = ((hashes.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
    ranks, least = _ranks()[:, :coordinates], None
    for at in range(0, len(places), 256):
        low = ranks[places[at:at + 256]].min(axis=0)
        least = low if least is None else np.minimum(least, low)
    return least


def _bands(sig: np.ndarray) -> list[int]:
    rows = sig[:BANDS * WIDTH].reshape(BANDS, WIDTH).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WIDTH):
            out = (out ^ rows[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(31)
    return out.view(np.int64).tolist()


def _sketch(sig: np.ndarray) -> list[int]:
    # a rank's own low bit: ranks are a permutation, so the bit is a fair coin
    return np.packbits((sig & 1).astype(np.uint8)).view(np.int64).tolist()


def _signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        n, digest, bands, sketch = [], [], [], []
        for text in pdf["text"]:
            h = shingle_hashes(text)
            n.append(len(h))
            digest.append(_set_id(h))
            sig = signature(h) if len(h) else None
            bands.append(_bands(sig) if len(h) else None)
            sketch.append(_sketch(sig) if len(h) else None)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "set_id": digest, "bands": bands, "sketch": sketch})


def _set_id(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = pd.DataFrame({"id": pdf["id"], "hashes": [shingle_hashes(t) for t in pdf["text"]]})
        # an id may stand on several texts; its set is the one that was chosen for it
        yield out[[_set_id(h) == s for h, s in zip(out["hashes"], pdf["set_id"], strict=True)]]


def _fine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"id": pdf["id"], "fine": [_sketch(signature(h, FINE)) for h in pdf["hashes"]]})


def signatures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch), one row per row of ``docs``."""
    plain = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(_signatures, "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the share. One set travels with
    each pair, the other side's set is sent once per representative."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    shared = F.size(F.array_intersect("ha", "hb"))
    total = F.size("ha") + F.size("hb") - shared
    return both.where(100 * shared >= SHARE * total).select("a", "b")


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar_size():
    """Sets whose sizes are further apart cannot reach the share."""
    return F.least("na", "nb") * 100 >= SHARE * F.greatest("na", "nb")


def _open(member: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (c: component) of the buckets that hold several components, with
    the component of most members as ``main``."""
    member = member.join(comp.withColumnRenamed("component_id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    main = (member.groupBy("band", "bucket", "c").count().groupBy("band", "bucket")
            .agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1"))
    return written(member.join(main.drop("parts"), ["band", "bucket"]), "open_members")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    every = signatures(docs, text_col, id_col)
    sigs = written(every.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("set_id")).alias("_")).agg(
        F.min_by(F.struct("n_shingles", "set_id", "bands", "sketch"), "set_id").alias("s")).select(
        "doc_id", F.coalesce("s.n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "s.set_id", "s.bands", "s.sketch"), "signatures")
    classes = written(sigs.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("m"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    # Buckets of one representative need nothing further. The centres of the
    # others are their smallest id and the ids least and greatest by a hash.
    by_hash = F.xxhash64("id")
    spread = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    centres = spread.groupBy("band", "bucket").agg(
        F.count("*").alias("members"), F.array(
            F.min("id"), F.min_by("id", by_hash), F.max_by("id", by_hash)).alias("centres")).where("members > 1").drop("members")
    crowded = written(spread.select("id", "band", "bucket").join(centres, ["band", "bucket"]), "crowded")
    ids = written(classes.select("id", "set_id").join(crowded.select("id").distinct(), "id", "left_semi"), "crowded_ids")
    wanted = broadcast_if(ids, ids.count())
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = written(plain.join(wanted, "id").mapInPandas(_sets, "id long, hashes array<long>")
                   .dropDuplicates(["id"]), "sets")
    size = classes.select("id", "n")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(_similar_size())
        return written(_linked(sized.select("a", "b"), sets), "links")

    tried = written(_pairs(crowded.select(F.explode("centres").alias("a"), F.col("id").alias("b"))), "tried")
    links = confirmed(tried)

    # Whoever is outside a bucket's main component meets the whole bucket, each
    # pair in the first band the two share. The fine sketch, made only for the
    # members of such buckets, leaves little but pairs near the share.
    open_ = _open(crowded.select("id", "band", "bucket"), components(links))
    fine = sets.join(open_.select("id").distinct(), "id", "left_semi").mapInPandas(_fine, "id long, fine array<long>")
    open_ = written(open_.join(classes.select("id", "n", "sketch", "bands"), "id").join(fine, "id"), "open_buckets")
    side = ("id", "c", "n", "sketch", "bands", "fine")
    x = open_.where("c <> main").select("band", "bucket", *[F.col(k).alias(f"{k}a") for k in side])
    y = open_.select(F.col("band").alias("band_"), F.col("bucket").alias("bucket_"), *[F.col(k).alias(f"{k}b") for k in side])
    differ = sum((F.bit_count(F.col("sketcha")[i].bitwiseXOR(F.col("sketchb")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    first = F.expr(f"filter(sequence(0, {BANDS - 1}), i -> bandsa[i] = bandsb[i])[0] = band")
    finer = F.expr("aggregate(zip_with(finea, fineb, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    both = (F.col("band") == F.col("band_")) & (F.col("bucket") == F.col("bucket_")) & (F.col("ca") != F.col("cb"))
    rest = x.join(y, both & _similar_size() & (differ <= MOST_DIFFERENT) & first & (finer <= MOST_DIFFERENT_FINE))
    rest = _pairs(rest.select(F.col("ida").alias("a"), F.col("idb").alias("b"))).join(tried, ["a", "b"], "left_anti")
    links = links.union(confirmed(rest))

    comp = components(links).withColumnRenamed("id", "class_id")
    named = written(classes.select(F.col("set_id").alias("k"), F.col("id").alias("class_id"), "m").join(comp, "class_id", "left").select(
        "k", "m", F.coalesce("component_id", "class_id").alias("c")), "named")
    # A set held by over 0.1 % of the documents is one of at most 1,000: those
    # join by broadcast, so no key of the shuffled join is hot.
    rows = sigs.select("doc_id", "n_shingles", "set_id")
    hot = F.col("m") * 1000 > sigs.count()
    tried = rows.join(F.broadcast(named.where(hot)), F.col("set_id") == F.col("k"), "left")
    answer = ["doc_id", "n_shingles", "c"]
    alone = tried.where("m is null and (set_id is null or doc_id is null)").select(*answer[:2], F.col("doc_id").alias("c"))
    rest = tried.where("m is null and set_id is not null and doc_id is not null").select(rows.columns).join(
        named.where(~hot), F.col("set_id") == F.col("k"))
    label = tried.where("m is not null").select(answer).unionByName(rest.select(answer)).unionByName(alone)
    label = label.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))
    return label.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document stays, all columns as they came.
    Dropped ids are a minority, so they are what is joined."""
    gone = written(near_duplicates(docs, text_col, id_col).where("not kept")
                   .select(F.col("doc_id").alias("_gone")).distinct(), "near_copies")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_did"))
    return rows.join(broadcast_if(gone, gone.count()), F.col("_did") == F.col("_gone"), "left_anti").select("_row.*")
