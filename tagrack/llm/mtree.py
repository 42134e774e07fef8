"""Exact top-k search by inner product: M-trees, best first.

Every vector is a row of whole numbers floor(256 x). Equal vectors are one
entry of the index (with the ids that can be in an answer: the k + 1 smallest),
so a group of copies, however large, is one entry. Entries go to their nearest
pivot; a pivot's entries are dealt into shards of a bounded size, and each shard
is loaded into an M-tree of its own: pages of entries around a routing object,
each entry with its covering radius and its distance to the page's routing
object (the parent distance), written as one Parquet row per page.

For a query q the score is linear, so |q.y - q.c| <= |q| d(y, c). That is the
triangle inequality the stored distances are used through: q.p known for the
parent p, an entry c with radius r holds nothing above q.p + |q| (d(c, p) + r);
only entries that may still reach the k-th best score have their own product
computed, and pages are opened in the order of q.c + |q| r, best first, until
the next bound is below the k-th best score. Bounds that equal it are opened, as
ties go to the smaller id.

Two rounds: each query first searches one shard of its best pivot, then, with
that k-th best score as its floor, every other shard whose bound by the stored
distances reaches the floor. Queries of one shard are dealt into groups of a
bounded size, so a shard that all queries want is read by many tasks.

Defined cases. Null vectors, empty ones, vectors with null or non-finite
entries or whose squared length as whole numbers is beyond a long, and rows
without id take no part. Vectors of different length are never compared. A
repeated id counts as one row: the smallest of its vectors in array order. Ties
go to the smaller id. No rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from .common import broadcast_if, written

SCALE = 256
NEAREST = 5
QUERY_STEP = 50
# Documented bounds of fitting: pivots come from about SAMPLE vectors; at most MOST_PIVOTS of them.
SAMPLE = 20_000
MOST_PIVOTS = 1_024
SHARD = 8_192
PAGE = 128
FAN = 32
QUERIES = 1_024
# Rounding of the bounds' double arithmetic, as a share of |q| (|y| + 1).
SLACK = 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows ``a`` with rows ``b``, as longs."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T  # wraps on the way, but the result fits a long


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows ``x`` to ``c``, rounded up."""
    return np.sqrt(((x.astype(float) - c.astype(float)) ** 2).sum(axis=-1)) * (1 + 1e-12)


# ---- loading -------------------------------------------------------------

def _halves(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """``rows`` in parts of at most ``most``, each split along the line between two far rows."""
    todo, done = [rows], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        p = x[part].astype(float)
        a = p[_far(p, p.mean(axis=0)).argmax()]
        line = p[_far(p, a).argmax()] - a
        order = np.argsort(p @ line, kind="stable")
        cut = max(most, (len(part) // 2 + most - 1) // most * most)  # full pages but the last
        todo += [part[order[:cut]], part[order[cut:]]]
    return done


def load(x: np.ndarray) -> list[dict]:
    """Pages of an M-tree over the rows of ``x``, root page last.

    A page: ``entries`` (rows of x for a leaf, page numbers above), ``objects``
    (row of x that routes each entry), ``radius`` of each entry (0 in a leaf),
    ``parent`` distance of each entry to the page's own object ``centre``,
    and the page's covering radius ``reach``.
    """
    def page(entries: np.ndarray, objects: np.ndarray, radius: np.ndarray, leaf: bool) -> dict:
        p = x[objects].astype(float)
        centre = objects[_far(p, p.mean(axis=0)).argmin()]
        parent = _far(x[objects], x[centre])
        return {"leaf": leaf, "entries": entries, "objects": objects, "radius": radius, "parent": parent,
                "centre": centre, "reach": float((parent + radius).max() * (1 + 1e-12))}

    pages = [page(rows, rows, np.zeros(len(rows)), True) for rows in _halves(x, np.arange(len(x)), PAGE)]
    level = list(range(len(pages)))
    while len(level) > 1:
        objects = np.array([pages[i]["centre"] for i in level])
        above = []
        for part in _halves(x[objects], np.arange(len(level)), FAN):
            numbers = np.array(level)[part]
            pages.append(page(numbers, objects[part], np.array([pages[i]["reach"] for i in numbers]), False))
            above.append(len(pages) - 1)
        level = above
    return pages


PAGES = ("dim int, pivot int, shard int, page int, leaf boolean, root boolean, reach double, centre binary, "
         "vectors binary, entries binary, radius binary, parent binary, ids array<array<long>>")


def _load(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The pages of one shard, as rows."""
    dim, pivot, shard = (int(k) for k in key)
    pdf = pdf.sort_values("first", ignore_index=True)
    x = np.stack(pdf["vector"].to_numpy())
    pages = load(x)
    out = []
    for i, p in enumerate(pages):
        out.append((dim, pivot, shard, i, p["leaf"], i == len(pages) - 1, p["reach"], x[p["centre"]].tobytes(),
                    x[p["objects"]].tobytes(), p["entries"].astype(np.int64).tobytes(), p["radius"].tobytes(),
                    p["parent"].tobytes(), [list(pdf["ids"][r]) for r in p["entries"]] if p["leaf"] else []))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])


# ---- searching one tree --------------------------------------------------

class Tree:
    """The pages of one shard, read back."""

    def __init__(self, pages: pd.DataFrame):
        self.pages = {}
        for r in pages.itertuples():
            dim = r.dim
            self.pages[r.page] = (r.leaf, np.frombuffer(r.vectors, np.int64).reshape(-1, dim), np.frombuffer(r.entries, np.int64),
                                  np.frombuffer(r.radius), np.frombuffer(r.parent), r.ids)
            if r.root:
                self.root, self.centre, self.reach = r.page, np.frombuffer(r.centre, np.int64)[None], r.reach
        self.computed = 0

    def search(self, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The best (score, id) of this tree, at most ``k``, none below ``floor``."""
        size = float(np.sqrt((q.astype(float) ** 2).sum()))
        best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
        least = floor
        q = q[None]
        own = int(products(q, self.centre)[0, 0])
        queue = [(-(own + size * self.reach), self.root, own)]
        while queue:
            bound, number, above = heapq.heappop(queue)
            if least is not None and -bound + SLACK * (size + 1) * (abs(bound) + 1) < least:
                break
            leaf, vectors, entries, radius, parent, ids = self.pages[number]
            near = np.arange(len(entries))
            if least is not None:  # by the stored parent distance, before any product
                reach = above + size * (parent + radius)
                near = np.nonzero(reach + SLACK * (size + 1) * (np.abs(reach) + 1) >= least)[0]
            if not len(near):
                continue
            self.computed += len(near)
            score = products(q, vectors[near])[0]
            if leaf:
                for i in np.argsort(-score, kind="stable"):
                    s = int(score[i])
                    if least is not None and s < least:
                        break
                    for d in ids[near[i]]:
                        if len(best) < k:
                            heapq.heappush(best, (s, -int(d)))
                        elif (s, -int(d)) > best[0]:
                            heapq.heapreplace(best, (s, -int(d)))
                        else:
                            break  # a copy's ids ascend
                    if len(best) == k:
                        least = best[0][0] if least is None else max(least, best[0][0])
            else:
                reach = score + size * radius[near]
                for i, b in zip(near, reach, strict=True):
                    heapq.heappush(queue, (-float(b), int(entries[i]), int(score[np.searchsorted(near, i)])))
        return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def _search(k: int):
    def run(key: tuple, pages: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(pages) and len(wanted):
            tree = Tree(pages)
            for r in wanted.itertuples():
                floor = None if pd.isna(r.floor) else int(r.floor)
                found += [(r.q, s, d) for s, d in tree.search(np.asarray(r.vector, np.int64), k, floor)]
        return pd.DataFrame(found, columns=["q", "score", "id"])
    return run


# ---- the index -----------------------------------------------------------

def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part; vector holds floor(256 x)."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("vector"))
    squared = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.where(squared < 2.0**62).groupBy("id").agg(F.min("vector").alias("vector"))


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors: vector, its smallest id and its ``keep`` smallest ids."""
    few = top_k(rows, ["vector"], [F.col("id").asc()], keep, "at")
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        "vector", "ids", F.col("ids")[0].alias("first"), F.size("vector").alias("dim"))


def _pivots(distinct: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Per vector length: rows of a bounded sample that lie far from each other."""
    share = distinct if n <= SAMPLE else distinct.where(
        F.pmod(F.xxhash64("first"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    sample = share.select("vector", "first").toPandas().sort_values("first")["vector"]
    found = {}
    for dim, part in sample.groupby(sample.map(len)):
        x = np.stack(part.to_numpy())
        groups = _halves(x, np.arange(len(x)), max(1, -(-len(x) // max(1, min(MOST_PIVOTS, n // SHARD)))))
        found[int(dim)] = np.stack([x[g[_far(x[g], x[g].astype(float).mean(axis=0)).argmin()]] for g in groups[:MOST_PIVOTS]])
    for r in distinct.select("dim").distinct().collect():
        found.setdefault(r["dim"], np.zeros((1, r["dim"]), np.int64))
    return found


def _lists(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _placed(pivots: dict[int, np.ndarray]):
    """Adds every entry's nearest pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x, p = _lists(part.column("vector"), dim).astype(float), pivots[int(dim)].astype(float)
                near = ((p**2).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near)], names=[*part.schema.names, "pivot"])
    return run


def _length(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q.astype(float) ** 2).sum(axis=1))


def _first_pivot(pivots: dict[int, np.ndarray]):
    """Per query the pivot of the highest score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                best = products(_lists(part.column("vector"), dim), pivots[int(dim)]).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("dim"), pa.array(best)], names=["q", "dim", "pivot"])
    return run


def _open_pivots(pivots: dict[int, np.ndarray], reach: dict[int, np.ndarray]):
    """Per query the pivots whose ball may reach its floor; all of them without a floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                q = _lists(part.column("vector"), dim)
                size, score = _length(q), products(q, pivots[int(dim)])
                bound = score + size[:, None] * reach[int(dim)][None]
                floor = part.column("floor").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                row, pivot = np.nonzero(bound + SLACK * (size[:, None] + 1) * (np.abs(bound) + 1) >= floor[:, None])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column("q").take(take), part.column("dim").take(take), pa.array(pivot.astype(np.int32)),
                    pa.array(score[row, pivot]), pa.array(size[row]), part.column("floor").take(take)],
                    names=["q", "dim", "pivot", "at", "size", "floor"])
    return run


SHARD_KEY = ["dim", "pivot", "shard"]


class Index:
    """M-trees over all distinct vectors: ``pages`` and the ``shards`` directory, both written."""

    def __init__(self, rows: DataFrame, keep: int = NEAREST + 1):
        self.keep = keep
        distinct = written(entries(rows, keep), "mtree_entries")
        self.n = distinct.count()
        self.pivots = _pivots(distinct, self.n) if self.n else {}
        placed = written(distinct.mapInArrow(_placed(self.pivots), "vector array<long>, ids array<long>, first long, dim int, pivot int"),
                         "mtree_placed")
        self.sizes = sizes = written(placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")), "mtree_sizes")
        dealt = placed.join(broadcast_if(sizes, sizes.count()), ["dim", "pivot"])
        dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("first"), F.col("shards")).cast("int"))
        self.pages = written(dealt.groupBy(*SHARD_KEY).applyInPandas(_load, PAGES), "mtree_pages")
        roots = self.pages.where("root").select(*SHARD_KEY, "reach", "centre")
        self.shards = written(roots.mapInArrow(self._directory(), "dim int, pivot int, shard int, reach double"), "mtree_shards")
        self.reach = {d: np.full(len(p), -np.inf) for d, p in self.pivots.items()}
        for r in self.shards.groupBy("dim", "pivot").agg(F.max("reach").alias("reach")).collect():  # at most one a pivot
            self.reach[r["dim"]][r["pivot"]] = r["reach"]

    def _directory(self):
        """A shard's covering radius around its pivot: root reach and the root's parent distance."""
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reach = [r + float(_far(np.frombuffer(c, np.int64), pivots[d][p])) for d, p, r, c in zip(
                    *(batch.column(x).to_pylist() for x in ("dim", "pivot", "reach", "centre")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SHARD_KEY), pa.array(reach, pa.float64())],
                                                 names=[*SHARD_KEY, "reach"])
        return run

    def _visit(self, visits: DataFrame, k: int) -> DataFrame:
        """Search every (q, vector, floor, shard) of ``visits``: (q, score, id), at most k each."""
        visits = written(visits, "mtree_visits")
        groups = visits.groupBy(*SHARD_KEY).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        groups = written(groups, "mtree_groups")
        known = broadcast_if(groups, groups.count())
        asked = visits.join(known, SHARD_KEY).withColumn("g", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int"))
        pages = self.pages.join(known, SHARD_KEY).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        key = [*SHARD_KEY, "g"]
        return written(pages.groupBy(*key).cogroup(asked.select(*key, "q", "vector", "floor").groupBy(*key)).applyInPandas(
            _search(k), "q long, score long, id long"), "mtree_found")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, rank, id, score) of the ``k`` best ids for each query (q, vector, dim);
        q must be unique. At most ``keep`` ids of equal vectors are known, so k <= keep."""
        if k > self.keep:
            raise ValueError(f"the index keeps {self.keep} ids of equal vectors; {k} are asked")
        queries = written(queries.select("q", "vector", "dim").where(F.col("dim").isin(sorted(self.pivots))), "mtree_queries")
        vectors = queries.select("q", "vector")
        first = queries.mapInArrow(_first_pivot(self.pivots), "q long, dim int, pivot int").join(
            broadcast_if(self.sizes, self.sizes.count()), ["dim", "pivot"])
        first = first.select("q", "dim", "pivot", F.pmod(F.xxhash64("q"), F.col("shards")).cast("int").alias("shard"))
        first = written(first, "mtree_first")
        near = self._visit(first.join(vectors, "q").withColumn("floor", F.lit(None).cast("long")), k)

        floors = near.groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("floor")).where(F.col("m") >= k)
        known = queries.join(floors.select("q", "floor"), "q", "left")
        still = known.mapInArrow(_open_pivots(self.pivots, self.reach), "q long, dim int, pivot int, at long, size double, floor long")
        bound = F.col("at") + F.col("size") * F.col("reach")
        reached = F.col("floor").isNull() | (bound + SLACK * (F.col("size") + 1) * (F.abs(bound) + 1) >= F.col("floor"))
        rest = (still.join(broadcast_if(self.shards, self.shards.count()), ["dim", "pivot"]).where(reached)
                .select("q", *SHARD_KEY, "floor").join(first, ["q", *SHARD_KEY], "left_anti").join(vectors, "q"))
        far = self._visit(rest, k)
        return top_k(near.unionByName(far), ["q"], [F.desc("score"), F.col("id")], k).select("q", "rank", "id", "score")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = NEAREST) -> DataFrame:
    """The ``k`` highest scores of every query row (``is_query`` over ``id``) among
    all other rows: query_id, rank, vec_id, score."""
    rows = written(whole(vectors, id_col, vector_col), "mtree_rows")
    index = Index(rows, k + 1)
    # equal query vectors are searched once, under the smallest of their ids
    asked = written(rows.where(is_query).select("id", "vector", F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")).alias("h")),
                    "mtree_asked")
    distinct = written(asked.groupBy("h").agg(F.min("id").alias("q"), F.count("*").alias("m"), F.first("vector").alias("vector")).withColumn(
        "dim", F.size("vector")), "mtree_distinct")
    found = index.search(distinct.select("q", "vector", "dim"), k + 1)
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    named = written(distinct.select(F.col("h").alias("k"), "q", "m").join(lists, "q").select("k", "m", "found"), "mtree_named")
    # a vector of over 0.1 % of the queries is one of at most 1,000: joined by broadcast, the rest holds no hot key
    hot = F.col("m") * 1000 > asked.count()
    asked = asked.select("id", "h")
    tried = asked.join(F.broadcast(named.where(hot)), F.col("h") == F.col("k"), "left")
    answers = tried.where("m is not null").select("id", "found").unionByName(
        tried.where("m is null").select("id", "h").join(named.where(~hot), F.col("h") == F.col("k")).select("id", "found"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
