"""Ranked lexical search: Block-Max MaxScore over document shards.

Index. Each task turns its documents into shards of a bounded number of
documents and postings, without a shuffle: per shard and term one row with the
postings (ordinals of ascending doc_id as gaps, and frequencies) as variable-
length integers in blocks of 128, the last ordinal and end byte of every block,
and per block the frontier of its (frequency, document length) pairs: the pairs
that no other pair of the block beats in both. As an impact rises with the
frequency and falls with the length, the frontier gives the exact block maximum
for any corpus statistics, so the index is built in one pass and needs no
second one when the corpus grows. One more row per shard holds its doc_ids and
lengths.

Search. Document frequencies and corpus totals are summed over all shards. The
lists of the asked terms meet in one task per shard and block of items. There,
per item, lists are ordered by their greatest contribution; the longest run of
lowest ones that together cannot beat the current k-th best score is
non-essential. Documents are taken in ascending windows: a window whose block
maxima cannot beat the k-th best is skipped undecoded; else only essential lists
are decoded, and their candidates must first pass the sum of the block maxima of
the non-essential lists, which is looked up without decompression; only
blocks of surviving candidates are decoded, greatest list first. The shards'
best k are merged by score, then doc_id.

All scores are whole numbers as in the contract of the query (``K1`` etc. below
are its constants).

Defined cases. A null or empty text, or one without a term, holds nothing and is
not counted among the documents. Rows without doc_id take no part. Rows
repeated with one doc_id are documents of their own. Ties go to the smaller
doc_id. Items without id, text or known terms give no rows; an item id that
repeats is searched once, by the smallest of its texts. Very long texts are read
whole. No documents or no items give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from .common import broadcast_if, written

BEST = 10
BLOCK = 128
WINDOW = 2_048
ITEMS = 256
# A shard ends when it holds so many documents or postings.
SHARD_DOCS = 32_768
SHARD_POSTINGS = 2_000_000
UNIT = 1_000
LENGTH_PERCENT = 75
K1_MILLE = 8

# A-Z become a-z; other ASCII but letters and digits separate terms; every byte
# of a character beyond ASCII belongs to a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_TERM_BYTES).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT**3 * tf) // (UNIT * tf + K1_MILLE * m)


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A document's m, from its length and the corpus totals."""
    top = LENGTH_PERCENT * docs
    if len(n) and int(n.max()) * top >= 2**63:
        return np.array([100 - LENGTH_PERCENT + int(x) * top // total for x in n.tolist()], np.int64)
    return 100 - LENGTH_PERCENT + (n * top) // total


# ---- variable-length integers ---------------------------------------------

def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value): 7 bits a byte, low bits first, high bit on all but the last."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        size += v >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, left = ends - size, v
    for i in range(int(size.max(initial=0))):
        has = size > i
        more = (size > i + 1)[has]
        out[at[has] + i] = (left[has] & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        left = left >> np.uint64(7)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    last = np.nonzero(data < 128)[0]
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first) if len(data) else np.zeros(0, np.int64)


# ---- index ------------------------------------------------------------------

LISTS = "shard long, term string, df long, total long, payload binary, lasts binary, ends binary, frontier binary"


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of ``data`` that end at ``ends`` (in elements) as one binary column."""
    offsets = np.concatenate([[0], ends]) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


class Shard:
    """Documents of one shard while it is gathered."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.columns: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int, text: bytes | None) -> None:
        found = terms(text)
        if not found:
            return
        counts = Counter(found)
        know = self.vocabulary.setdefault
        columns = np.empty((3, len(counts)), np.int64)
        columns[0] = [know(t, len(self.vocabulary)) for t in counts]
        columns[1] = len(self.ids)
        columns[2] = list(counts.values())
        self.columns.append(columns)
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The rows of the shard: its lists by term, and the row of its documents."""
        if not self.ids:
            return
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")
        ordinal = np.empty(len(ids), np.int64)
        ordinal[order] = np.arange(len(ids))
        words = sorted(self.vocabulary)
        rank = np.empty(len(words), np.int64)
        rank[[self.vocabulary[t] for t in words]] = np.arange(len(words))
        term, doc, tf = np.concatenate(self.columns, axis=1)
        term, n, doc = rank[term], lengths[doc], ordinal[doc]
        by = np.lexsort((doc, term))
        term, doc, tf, n = term[by], doc[by], tf[by], n[by]

        starts = np.concatenate([[0], np.nonzero(np.diff(term))[0] + 1])
        df = np.diff(np.append(starts, len(term)))
        place = np.arange(len(term)) - np.repeat(starts, df)
        gap = np.diff(doc, prepend=-1)
        gap[starts] = doc[starts] + 1
        data, ends = pack(np.column_stack([gap, tf]).ravel())
        ends = ends[1::2]
        begins = np.nonzero(place % BLOCK == 0)[0]
        closes = np.append(begins[1:], len(term)) - 1
        blocks = -(-df // BLOCK)
        list_end = ends[starts + df - 1]
        list_begin = np.concatenate([[0], list_end[:-1]])
        lasts = doc[closes].astype(np.int32)
        block_ends = (ends[closes] - np.repeat(list_begin, blocks)).astype(np.int32)

        # frontier: by ascending length, the frequencies that rise
        block = np.repeat(np.arange(len(begins)), closes - begins + 1)
        by = np.lexsort((-tf, n, block))
        height = block[by] * (int(tf.max()) + 1) + tf[by]
        peak = np.maximum.accumulate(height)
        keep = by[np.concatenate([[True], peak[1:] > peak[:-1]])]
        inner = block[keep] - np.repeat(np.cumsum(blocks) - blocks, blocks)[block[keep]]
        frontier = np.column_stack([inner, tf[keep], n[keep]]).astype(np.int64)
        per_list = np.bincount(term[keep], minlength=len(words))

        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(words), shard)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(df), pa.nulls(len(words), pa.int64()),
            _binary(data, list_end), _binary(lasts, np.cumsum(blocks)), _binary(block_ends, np.cumsum(blocks)),
            _binary(frontier.ravel(), 3 * np.cumsum(per_list))], names=[c.split()[0] for c in LISTS.split(", ")])
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), pa.nulls(1, pa.string()), pa.array([len(ids)]), pa.array([int(lengths.sum())]),
            pa.array([ids[order].tobytes()], pa.binary()), pa.array([lengths[order].tobytes()], pa.binary()),
            pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=[c.split()[0] for c in LISTS.split(", ")])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, shard = TaskContext.get().partitionId() << 32, Shard()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for i, text in enumerate(batch.column("text")):
            shard.add(ids[i], text.as_buffer().to_pybytes() if text.is_valid else None)
            if shard.full():
                yield from shard.batches(number)
                number, shard = number + 1, Shard()
    yield from shard.batches(number)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents: the lists of every shard, written."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null and text is not null")
    return written(rows.mapInArrow(_index, LISTS), "lists")


# ---- search -----------------------------------------------------------------

class PostingList:
    """One list of a shard, decoded block by block on demand."""

    def __init__(self, row, norm: np.ndarray, docs: int, total: int):
        self.data = np.frombuffer(row.payload, np.uint8)
        self.lasts = np.frombuffer(row.lasts, np.int32)
        self.ends = np.frombuffer(row.ends, np.int32)
        block, tf, n = np.frombuffer(row.frontier, np.int64).reshape(-1, 3).T
        most = impact(tf, length_norm(n, docs, total))
        self.most = np.maximum.reduceat(most, np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1]))
        self.greatest = int(self.most.max())
        self.norm = norm
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, impacts) of one block."""
        got = self.known.get(b)
        if got is None:
            values = unpack(self.data[self.ends[b - 1] if b else 0:self.ends[b]])
            doc = np.cumsum(values[::2]) + (int(self.lasts[b - 1]) if b else -1)
            got = self.known[b] = doc, impact(values[1::2], self.norm[doc])
        return got

    def bounds(self, docs: np.ndarray) -> np.ndarray:
        """The block maxima where ``docs`` would be; nothing is decoded."""
        at = np.searchsorted(self.lasts, docs)
        return np.where(at < len(self.lasts), self.most[np.minimum(at, len(self.lasts) - 1)], 0)

    def values(self, docs: np.ndarray) -> np.ndarray:
        """Impacts of ascending ``docs``; decodes the blocks that may hold them."""
        out = np.zeros(len(docs), np.int64)
        at = np.searchsorted(self.lasts, docs)
        for b in np.unique(at[at < len(self.lasts)]):
            mine = np.nonzero(at == b)[0]
            doc, value = self.block(int(b))
            place = np.minimum(np.searchsorted(doc, docs[mine]), len(doc) - 1)
            out[mine] = np.where(doc[place] == docs[mine], value[place], 0)
        return out


def best_documents(lists: list[tuple[PostingList, int]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordinals, scores) of the ``k`` best documents of a shard of ``size``; lists come with their weights."""
    lists = sorted((x for x in lists if x[1] > 0), key=lambda x: x[0].greatest * x[1])
    prefix = np.cumsum([0] + [p.greatest * w for p, w in lists])
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for begin in range(0, size, WINDOW):
        end = min(begin + WINDOW, size)
        # essential are the lists from which on the bounds beat the k-th best
        cut = int(np.searchsorted(prefix, least, side="right")) - 1
        if cut >= len(lists):
            break
        inside, most = [], int(prefix[cut])
        for p, w in lists[cut:]:
            b0, b1 = np.searchsorted(p.lasts, (begin, end - 1))
            if b0 < len(p.lasts):
                blocks = range(int(b0), min(int(b1) + 1, len(p.lasts)))
                inside.append((p, w, blocks))
                most += w * int(p.most[blocks.start:blocks.stop].max())
        if most <= least or not inside:
            continue
        sums = np.zeros(end - begin, np.int64)
        for p, w, blocks in inside:
            for b in blocks:
                doc, value = p.block(b)
                if doc[0] < begin or doc[-1] >= end:
                    within = slice(*np.searchsorted(doc, (begin, end)))
                    doc, value = doc[within], value[within]
                sums[doc - begin] += w * value
        found = np.nonzero((sums > 0) & (sums + prefix[cut] > least))[0]
        score, found = sums[found], found + begin
        if cut and len(found):
            bound = np.array([w * p.bounds(found) for p, w in lists[:cut]])
            rest = bound.sum(axis=0)
            for i in range(cut - 1, -1, -1):
                alive = score + rest > least
                found, score, rest, bound = found[alive], score[alive], rest[alive], bound[:, alive]
                if not len(found):
                    break
                p, w = lists[i]
                rest = rest - bound[i]
                score = score + w * p.values(found)
        alive = score > least
        docs, scores = np.concatenate([docs, found[alive]]), np.concatenate([scores, score[alive]])
        top = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[top], scores[top]
        if len(docs) == k:
            least = int(scores[-1])
    return docs, scores


def _search(docs: int, total: int, k: int):
    """The best of one shard for the items of one block."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["term"].isna()].iloc[0]
        ids, lengths = np.frombuffer(own["payload"], np.int64), np.frombuffer(own["lasts"], np.int64)
        norm = length_norm(lengths, docs, total)
        items: dict[int, list] = {}
        for row in pdf[pdf["term"].notna()].itertuples():
            p = PostingList(row, norm, docs, total)
            for use in row.uses:
                items.setdefault(use["item_id"], []).append((p, int(row.w) * use["times"]))
        out = []
        for item, lists in items.items():
            doc, score = best_documents(lists, len(ids), k)
            out.append(pd.DataFrame({"item_id": item, "doc_id": ids[doc], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"item_id": [], "doc_id": [], "score": []}, dtype="int64")
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t, n) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True)
                for t, n in Counter(terms(text.as_buffer().to_pybytes())).items()]
        item, term, times = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()),
                                          pa.array(times, pa.int64())], names=["item_id", "term", "times"])


def search(lists: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of the index for each item."""
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(
        "item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    asked = written(texts.mapInArrow(_item_terms, "item_id long, term string, times long"), "asked")
    uses = asked.count()
    groups = max(1, -(-asked.select("item_id").distinct().count() // ITEMS))
    whole = lists.where("term is null").agg(F.sum("df").alias("docs"), F.sum("total").alias("total")).first()
    docs, total = whole["docs"] or 0, whole["total"] or 0

    wanted = asked.select("term").distinct()
    df = lists.where("term is not null").select("term", "df").join(broadcast_if(wanted, uses), "term", "left_semi")
    df = df.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(UNIT * F.log((2 * F.lit(docs) + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(df, "term").withColumn("w", weight).where("w > 0")
    weighted = weighted.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int").alias("g"), "term", "w").agg(
        F.collect_list(F.struct("item_id", "times")).alias("uses"))
    weighted = written(weighted, "weighted")
    found = lists.where("term is not null").drop("df", "total").join(broadcast_if(weighted, uses), "term")
    own = lists.where("term is null").select(
        "shard", "term", "payload", "lasts", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    parts = found.unionByName(own, allowMissingColumns=True).groupBy("shard", "g").applyInPandas(
        _search(docs, max(1, total), k), "item_id long, doc_id long, score long")
    return top_k(parts, ["item_id"], [F.desc("score"), F.col("doc_id")], k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    return search(build(docs), items, k)
