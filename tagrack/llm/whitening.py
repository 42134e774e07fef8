"""Whitening of embeddings: leading principal components by Jacobi-Davidson.

The covariance matrix is never formed. Its product with a few columns is one
Spark job over written blocks of centred rows: each task adds up C'(C u) for its
blocks and Spark sums the numbers. The correction equations of all open Ritz
pairs are solved side by side by MINRES, so an inner step is one such job for
the whole block; Rayleigh-Ritz works on the kept subspace, leading pairs are
locked in order, and the loop ends when a fresh product shows every residual at
double precision. The driver holds a few columns of the vectors' length, never
a matrix of that length squared and nothing that grows with the rows.

Numbers: an entry c becomes x = floor(1024 c) + 100000, a long. Centring is
exact (n x - S in whole numbers) before the one division, so no digits are lost
to the size of x.

Defined cases. Null vectors, empty ones and vectors with null or non-finite
entries, or with an entry of 2^40 and more, are dropped. If lengths differ, the
commonest length is used (of equally common ones the longest) and the other
rows are dropped. Rows with repeated or null ids are rows like any other. A
component whose eigenvalue is 0 up to rounding (fewer distinct rows than
components, constant entries) is left out, so one single row, equal rows and an
empty table give no rows. A deviation beyond a long is null. Extra columns are
ignored. Equal eigenvalues: any orthonormal basis of their space.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
MOST_ENTRY = float(2**40)
# Columns beyond the wanted ones that are searched with them, and how many blocks of columns a subspace keeps.
GUARD = 4
KEPT_BLOCKS = 6
INNER_STEPS = 10
# A residual of double precision, as a share of the largest eigenvalue.
PRECISION = 64 * np.finfo(float).eps
OUTER_STEPS = 200
STALE = 20
BLOCK_BYTES = 1 << 20
SLICE = 512

_log = logging.getLogger(__name__)


def _orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``x`` made orthonormal and orthogonal to ``against``; dependent ones go."""
    out = np.zeros((len(x), 0))
    for column in x.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):  # repeated, as one projection leaves rounding of the removed part
            for q in (against, out):
                column = column - q @ (q.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.column_stack([out, column])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Side by side solutions of symmetric systems, one per column of ``rhs``.

    Stops after ``steps`` products or once every residual is ``share`` of its start.
    """
    size = np.linalg.norm(rhs, axis=0)
    tiny = np.finfo(float).tiny ** 0.5
    v = rhs / np.maximum(size, tiny)
    v_old, w, w_old, x = (np.zeros_like(rhs) for _ in range(4))
    eta, beta = size.copy(), np.zeros_like(size)
    c, c_old, s, s_old = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        below = np.maximum(np.hypot(delta, beta_new), tiny)
        w_old, w = w, (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / below
        c_old, c, s_old, s = c, delta / below, s, beta_new / below
        x = x + c * eta * w
        eta = -s * eta
        if (np.abs(eta) <= share * size).all():
            break
        v_old, v, beta = v, p / np.maximum(beta_new, tiny), beta_new
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], length: int, wanted: int,
                    seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), the ``wanted`` largest ones first, of
    the symmetric non-negative operator ``product``, which maps (length, k) to (length, k)."""
    random = np.random.default_rng(seed)
    wanted = min(wanted, length)
    block = min(length, wanted + GUARD)
    none = np.zeros((length, 0))
    locked, basis = none, _orthonormal(random.standard_normal((length, block)), none)
    images = product(basis)
    scale, best, stale, proofs = 0.0, np.inf, 0, 0
    for outer in range(OUTER_STEPS):
        # Rayleigh-Ritz on the kept subspace
        inner = basis.T @ images
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, image = basis @ turn, images @ turn
        scale = max(scale, float(np.abs(theta).max(initial=0.0)))
        off = image - ritz * theta
        off -= locked @ (locked.T @ off)
        miss = np.linalg.norm(off, axis=0)

        # lock leading pairs, in order, that have reached double precision
        limit = PRECISION * scale if stale < STALE else np.inf
        done = 0
        while done < min(wanted - locked.shape[1], len(theta)) and miss[done] <= limit:
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            ritz, image, off, theta, miss = ritz[:, done:], image[:, done:], off[:, done:], theta[done:], miss[done:]
            best, stale = np.inf, 0
        if locked.shape[1] == wanted:
            values, locked, worst = _proved(product, locked)
            proofs += 1
            if worst <= PRECISION * scale or proofs > 3:
                if worst > PRECISION * scale:
                    _log.warning("largest residual %.3g of the largest eigenvalue", worst / scale)
                return values, locked
            basis, locked = _orthonormal(np.column_stack([locked, ritz]), none), none
            images = product(basis)
            continue
        stale = stale + 1 if miss[0] >= 0.9 * best else 0
        best = min(best, miss[0])

        if ritz.shape[1] + block > KEPT_BLOCKS * block:
            ritz, image = ritz[:, :2 * block], image[:, :2 * block]  # restart from the leading pairs
        basis, images = ritz, image
        taken = np.column_stack([locked, basis])
        room = length - taken.shape[1]
        if not room:
            images = product(basis)  # the whole space: only rounding is left to mend
            continue

        # correction equations of the open pairs, side by side
        u, shift, right = ritz[:, :block], theta[:block], -off[:, :block]

        def project(x, u=u, locked=locked):
            x = x - u * (u * x).sum(axis=0)
            return x - locked @ (locked.T @ x)

        def apply(x, shift=shift, project=project):
            x = project(x)
            return project(product(x) - shift * x)

        step = minres(apply, project(right), INNER_STEPS, 2.0 ** -(outer + 2))
        more = _orthonormal(np.column_stack([step, right]), taken)
        if not more.shape[1]:
            more = _orthonormal(random.standard_normal((length, block)), taken)
        more = more[:, :min(room, block)]
        basis, images = np.column_stack([basis, more]), np.column_stack([images, product(more)])
    raise ArithmeticError("no eigenpairs of double precision")


def _proved(product, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, vectors and largest residual by a fresh product of the locked space."""
    vectors = _orthonormal(vectors, np.zeros((len(vectors), 0)))
    images = product(vectors)
    inner = vectors.T @ images
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors, images = vectors @ turn, images @ turn
    return values, vectors, float(np.linalg.norm(images - vectors * values, axis=0).max(initial=0.0))


@dataclass
class Whitening:
    """A fitted whitening: x-vectors are centred by ``total`` / ``n`` and projected on
    ``components`` (columns), each divided by the root of its eigenvalue."""
    n: int
    total: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST_ENTRY))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    rows = rows.where(F.size("v") == (common[0]["k"] if common else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _totals(length: int):
    """Per task and dimension: rows, sum, least and largest x."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * length
        least, most = np.full(length, np.iinfo(np.int64).max), np.full(length, np.iinfo(np.int64).min)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # 512 entries below 2^51 add up within a long
                x = _matrix(batch.slice(at, SLICE).column("x"), length)
                n += len(x)
                total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array(map(str, total), pa.string()),
                 pa.array(least), pa.array(most)], names=["i", "n", "s", "least", "most"])
    return run


def _numerators(x: np.ndarray, n: int, total: np.ndarray, wide: bool) -> np.ndarray:
    """n x - S, exactly; as Python numbers where a long may not hold them."""
    return x.astype(object) * n - total if wide else x * n - total


def _packed(length: int, n: int, total: np.ndarray, wide: bool):
    """Blocks of centred rows as bytes of doubles."""
    rows = max(1, BLOCK_BYTES // (8 * length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                y = _numerators(_matrix(batch.slice(at, rows).column("x"), length), n, total, wide)
                yield pa.RecordBatch.from_arrays([pa.array([(y.astype(float) / n).tobytes()], pa.binary())], names=["block"])
    return run


def _summed(blocks: DataFrame, length: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``part(block)``, an array of a fixed size; one job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("block"):
                got = part(np.frombuffer(block.as_buffer(), float).reshape(-1, length)).ravel()
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])
    rows = blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    out[[r["i"] for r in rows]] = [r["v"] for r in rows]
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all of ``rows`` (vec_id, x); None if there are none."""
    first = rows.select(F.size("x")).head()
    if first is None:
        return None
    length = first[0]
    stats = rows.mapInArrow(_totals(length), "i int, n long, s string, least long, most long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"),
        F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    n, total = stats[0]["n"], [int(r["s"]) for r in stats]
    wide = any(n * max(abs(r["least"]), abs(r["most"])) + abs(int(r["s"])) >= 2**62 for r in stats)
    sums = np.array(total, object if wide else np.int64)
    blocks = written(rows.select("x").mapInArrow(_packed(length, n, sums, wide), "block binary"), "centred")

    def product(u: np.ndarray) -> np.ndarray:
        return _summed(blocks, length, lambda c: c.T @ (c @ u)).reshape(u.shape) / n

    trace = float(_summed(blocks, length, lambda c: (c * c).sum(axis=0)).sum() / n)
    if not trace > 0:
        return Whitening(n, total, np.zeros(0), np.zeros((length, 0)), trace, 0.0)
    values, vectors = jacobi_davidson(product, length, components)
    real = values > length * PRECISION * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    weight = vectors / np.sqrt(values)

    def spread(c: np.ndarray) -> np.ndarray:
        y = c @ weight
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    k = len(values)
    sums = _summed(blocks, length, spread) / n
    got = sums[:k * k].reshape(k, k) - np.outer(sums[k * k:], sums[k * k:])
    return Whitening(n, total, values, vectors, trace, float(np.abs(got - np.eye(k)).max(initial=0.0)))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row per row of ``rows`` (vec_id, x) and component."""
    n, k, length = model.n, len(model.values), len(model.total)
    weight = model.components / np.sqrt(model.values)
    explained = model.values / model.trace
    number = np.arange(1, k + 1, dtype=np.int32)
    total = np.array(model.total, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = _matrix(part.column("x"), length)
                small = int(np.abs(x).max()) * n < 2**61 and max(map(abs, model.total)) < 2**61
                y = _numerators(x, n, total.astype(np.int64) if small else total, not small)
                far = int(np.abs(y).max())
                square = (y.astype(object) if far * far * length >= 2**63 else y) ** 2
                deviation = [d if d < 2**63 else None for d in square.sum(axis=1).tolist()]
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(number, m)),
                    pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(((y.astype(float) / n) @ weight).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error))], names=schema.names)

    schema = rows.select("vec_id").schema
    for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
                       ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    rows = written(scaled(vectors, id_col, vector_col), "scaled")
    model = fit(rows, components)
    if model is None:
        model = Whitening(1, [0], np.zeros(0), np.zeros((1, 0)), 1.0, 0.0)
    return transform(rows, model)
