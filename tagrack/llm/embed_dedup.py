"""Near-duplicate embeddings: sketches first, then spherical k-means cells and blocked cosines inside.

Vectors are compared only under equal labels. Equal vectors of a label form one
class and only classes are compared. A class is first a sketch of a few bytes:
its unit vector on orthonormal directions, rounded. A projection lengthens no
distance and rounding moves a sketch by a known length at most, so linked
classes have sketches within ``_bound``; classes without another such sketch
have no link and go no further. The rest are compared as whole vectors.

Centres come from a bounded sample; every
class goes to its nearest centre's cell. A link can cross a cell border, so a
class is also sent to every lower cell in which a neighbour could live: if y
lies in cell c and |x - y| <= d, then x.(a - c) <= d |a - c| for x's own centre
a. So no link is lost. Cells are compared block by block, each block
pair in a task of its own, which returns link counts and the blocks' own
components, never the pairs. Sketches meet by the same rule in larger cells,
as many as a label's classes ask for.

Defined cases. Null or zero vectors, vectors with null or non-finite
components, and rows with null label or id link with nothing. Vectors of
different length are never compared. Ties: the smallest id represents a component.
Rows repeated with one id are counted as vectors of their own but share their
component. Null ids get a null component. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, written
from .components import components

THRESHOLD = 0.98
# Documented bounds: centres are fitted on about SAMPLE vectors; at most MOST_CELLS cells.
SAMPLE = 20_000
MOST_CELLS = 2_048
BLOCK = 1_024
ROUNDS = 8
# A sketch's directions, and its steps per unit of length.
DIRECTIONS, STEPS = 24, 127
# Classes of a sketch cell, and blocks of guests as a multiple of them.
SKETCH_CELL, SKETCH_GUESTS = 131_072, 4
# Numbers that a task holds at once beside its input, in each of a few arrays.
HELD = 1 << 20
TILE = 512
REACH = sqrt(2 - 2 * THRESHOLD)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, HELD // len(centres))
    return np.concatenate([(x[lo:lo + step] @ centres.T).argmax(axis=1) for lo in range(0, len(x), step)])


def fit_centres(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on unit rows; starts at rows spread over the sample."""
    centres = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return centres


def _directions(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns, at most ``DIRECTIONS``, along which unit rows spread most."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :DIRECTIONS]


def _bound(directions: int, reach: float) -> float:
    """Greatest distance, in steps, of sketches whose unit vectors lie within ``reach``."""
    return STEPS * reach + sqrt(directions) + 1e-3  # each side is rounded by half a step per direction


def _unit(vectors) -> np.ndarray:
    v = vectors.astype(float) if isinstance(vectors, np.ndarray) else np.array([np.asarray(x, float) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cells(centres: dict[tuple[int, int], np.ndarray], reach: float, directions: dict[int, np.ndarray] | None = None):
    """For ``mapInArrow``: (dim, cell, home) rows of every class, its own cell and lower cells
    within reach, of the centres that its length and column ``k`` name. With ``directions``
    the vector gives place to its sketch."""
    # unit rows (a zero row only where no sample had the length): |a - b| from their products
    square = {key: (c * c).sum(axis=1) for key, c in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.stack([pc.list_value_length(batch.column("vector")).to_numpy(), batch.column("k").to_numpy()], axis=1)
            for dim, k in map(tuple, np.unique(of, axis=0).tolist()):
                same, c = np.nonzero((of == (dim, k)).all(axis=1))[0], centres[dim, k]
                step = max(1, HELD // max(len(c), dim))
                for lo in range(0, len(same), step):
                    yield from place(batch.take(pa.array(same[lo:lo + step])), dim, c, square[dim, k])

    def place(part: pa.RecordBatch, dim: int, c: np.ndarray, squares: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit = _unit(part.column("vector").flatten().to_numpy().reshape(-1, dim))
        near = unit @ c.T
        own = near.argmax(axis=1)
        between = squares[own][:, None] + squares[None] - 2 * c[own] @ c.T
        gap = np.sqrt(np.maximum(between, 0) + 1e-12)  # no less than the distance, rounding included
        within = near[np.arange(len(own)), own][:, None] - near <= reach * gap + 1e-9
        within &= np.arange(len(c))[None] <= own[:, None]
        row, cell = np.nonzero(within)
        names, kept = part.schema.names, [part.column(n) for n in part.schema.names]
        if directions is not None:
            steps = np.rint(unit @ directions[dim] * STEPS).astype(np.int8)
            sketch = pa.array([x.tobytes() for x in steps], pa.binary())
            names, kept = [*names[:-2], "sketch"], [*kept[:-2], sketch]  # for vector and k
        else:
            names, kept = names[:-1], kept[:-1]
        size = max(1, HELD // (8 if directions is not None else dim))
        for lo in range(0, len(row), size):
            at, here = pa.array(row[lo:lo + size]), cell[lo:lo + size]
            yield pa.RecordBatch.from_arrays(
                [*[x.take(at) for x in kept], pa.array(np.full(len(here), dim), pa.int32()), pa.array(here, pa.int32()),
                 pa.array(here == own[row[lo:lo + size]])], [*names, "dim", "cell", "home"])
    return run


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable, for a symmetric 0/1 matrix with ones on the diagonal."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None], len(root)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one block pair: left rows with right rows, or one block with itself."""
    pdf = pdf.sort_values("id", ignore_index=True)
    unit = _unit(pdf["vector"])
    linked = unit @ unit.T >= THRESHOLD
    side = pdf["side"].to_numpy()
    if (side != 0).any():
        linked &= side[:, None] != side[None]
    np.fill_diagonal(linked, False)
    links = linked @ pdf["m"].to_numpy()
    hit = np.nonzero(links)[0]
    root = _components(linked | np.eye(len(linked), dtype=bool))
    return pd.DataFrame({"id": pdf["id"].to_numpy()[hit], "links": links[hit], "root": pdf["id"].to_numpy()[root[hit]]})


def _near(table: pa.Table) -> pa.Table:
    """Classes of one block pair that have another sketch within the bound."""
    n, side = table.num_rows, table.column("side").to_numpy()
    q = np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.int8) for c in table.column("sketch").chunks]).reshape(n, -1)
    # half of |x|**2 + |y|**2 - |x - y|**2, of whole numbers and halves under 2**24: exact
    half = np.einsum("ij,ij->i", q, q, dtype=np.float32)[:, None] / 2
    least = -_bound(q.shape[1], REACH) ** 2 / 2
    left, right, hit = np.nonzero(side < 2)[0], np.nonzero(side == 2)[0], np.zeros(n, bool)
    alone = not side.any()
    for lo in range(0, len(left), TILE):
        i = left[lo:lo + TILE]
        x = np.hstack([q[i].astype(np.float32), -half[i], np.ones_like(half[i])])
        for at in range(lo if alone else 0, len(left) if alone else len(right), TILE):
            j = (left if alone else right)[at:at + TILE]
            score = x @ np.hstack([q[j].astype(np.float32), np.ones_like(half[j]), -half[j]]).T
            if alone and at == lo:
                np.fill_diagonal(score, -np.inf)
            if score.max() >= least:
                close = score >= least
                hit[i] |= close.any(axis=1)
                hit[j] |= close.any(axis=0)
    return pa.table({"no": table.column("no").filter(pa.array(hit))})


def _block_pairs(cells: DataFrame, by: Column, home: int, guest: int) -> DataFrame:
    """Rows of ``cells`` for every block pair (i, j, guest) they take part in, with their ``side``:
    home block i with home block j >= i, and home block i with guest block j."""
    sizes = cells.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / home).alias("homes"),
        F.ceil(F.sum((~F.col("home")).cast("int")) / guest).alias("guests"))
    sizes = written(sizes, "cell_sizes")
    placed = cells.join(broadcast_if(sizes, sizes.count()), ["label", "dim", "cell"])
    mine = F.pmod(F.xxhash64(by), F.when(F.col("home"), F.col("homes")).otherwise(F.greatest("guests", F.lit(1)))).cast("int")
    placed = placed.where("homes > 0").withColumn("b", mine)
    work = F.expr("""if(home,
        concat(transform(sequence(0, int(homes) - 1), j -> struct(least(b, j) as i, greatest(b, j) as j, false as guest,
                         case when j = b then 0 when b < j then 1 else 2 end as side)),
               if(guests > 0, transform(sequence(0, int(guests) - 1), g -> struct(b as i, g as j, true as guest, 1 as side)),
                  array())),
        transform(sequence(0, int(homes) - 1), i -> struct(i as i, b as j, true as guest, 2 as side)))""")
    return placed.withColumn("w", F.explode(work)).select(*cells.columns, "w.*").drop("home")


def _sample(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit rows of about ``SAMPLE`` classes by their length; a length without any gets one direction."""
    share = classes if n <= SAMPLE else classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    sample = share.select("vector").toPandas()["vector"]
    unit = {dim: _unit(part) for dim, part in sample.groupby(sample.map(len))}
    for (dim,) in classes.select(F.size("vector")).distinct().collect():
        unit.setdefault(dim, np.eye(1, dim))
    return unit


def _with_neighbours(classes: DataFrame, n: int) -> DataFrame:
    """The classes with another sketch of their label within the bound: all that may have links."""
    unit = _sample(classes, n)
    # labels of several cells are few: at most n / SKETCH_CELL
    large = written(classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("m")).where(F.col("m") > SKETCH_CELL).select(
        F.col("label").alias("l"), F.col("dim").alias("d"),
        F.least(F.lit(MOST_CELLS), F.pow(F.lit(2), F.ceil(F.log2(F.col("m") / SKETCH_CELL))).cast("int")).alias("k")), "large_labels")
    ladder = {(d, k) for d, k in large.select("d", "k").distinct().collect()} | {(dim, 1) for dim in unit}
    centres = {(dim, k): fit_centres(unit[dim], min(k, len(unit[dim]))) for dim, k in sorted(ladder)}
    asked = classes.join(broadcast_if(large, large.count()), (F.col("label") == F.col("l")) & (F.size("vector") == F.col("d")), "left").select(
        "no", "label", "vector", F.coalesce("k", F.lit(1)).alias("k"))
    out = T.StructType([f for f in asked.schema if f.name in ("no", "label")]).add("sketch", T.BinaryType()).add(
        "dim", T.IntegerType()).add("cell", T.IntegerType()).add("home", T.BooleanType())
    cells = asked.mapInArrow(_cells(centres, REACH, {dim: _directions(x) for dim, x in unit.items()}), out)
    pairs = _block_pairs(cells, F.col("no"), SKETCH_CELL, SKETCH_CELL * SKETCH_GUESTS)
    near = written(pairs.groupBy("label", "dim", "cell", "i", "j", "guest").applyInArrow(_near, "no long").distinct(), "near")
    return classes.join(broadcast_if(near, near.count()), "no", "left_semi")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label",
                    vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col("vector")
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))
    kind = vectors.schema[vector_col].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):  # single precision stays: half the bytes
        kind = T.ArrayType(T.DoubleType())
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # 128 bits of hash name a vector; classes are the distinct vectors of a label
    named_by = v.cast("array<double>")
    rows = rows.withColumn("h", F.when(F.col("sound"), F.struct(F.xxhash64(named_by), F.xxhash64(F.lit(1), named_by))))
    classes = written(rows.where("sound").groupBy("label", "h").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("vector").alias("vector")).withColumn(
        "no", F.monotonically_increasing_id()), "classes")
    close = written(_with_neighbours(classes, classes.count()).select("id", "label", "vector", "m"), "close")
    n = close.count()

    # cells fit the largest label: more of them would only add copies at their borders
    most = close.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    k = max(1, min(MOST_CELLS, ceil(most / BLOCK)))
    centres = {(dim, 0): fit_centres(x, min(k, len(x))) for dim, x in _sample(close, n).items()}
    asked = close.select("id", "label", "m", "vector", F.lit(0).alias("k"))
    cells = written(asked.mapInArrow(_cells(centres, REACH), T.StructType(asked.schema.fields[:-1]).add(
        "dim", T.IntegerType()).add("cell", T.IntegerType()).add("home", T.BooleanType())), "cells")
    found = written(_block_pairs(cells, F.col("id"), BLOCK, BLOCK).groupBy("label", "dim", "cell", "i", "j", "guest").applyInPandas(
        _compare, "id long, links long, root long"), "cell_links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))

    named = written(classes.select("label", "h", "id", "m").join(links, "id", "left").join(comp, "id", "left").select(
        F.col("label").alias("l"), F.col("h").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), "m"), "named")
    rows = rows.select("vec_id", "label", "h")
    # a vector held by over 0.1 % of all rows is one of at most 1,000: joined by broadcast
    hot = F.col("m") * 1000 > vectors.count()
    same = (F.col("label") == F.col("l")) & (F.col("h") == F.col("k"))
    answer = ["vec_id", "n_links", "component_id"]
    first = rows.join(F.broadcast(named.where(hot)), same, "left")
    big = first.where("m is not null").select(answer)
    rest = (first.where("m is null").select(rows.columns).join(named.where(~hot), same, "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
    out = big.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
