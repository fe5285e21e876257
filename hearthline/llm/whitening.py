"""Whitening of vectors: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

The covariance V is never formed. A block Q of twice as many columns as are wanted is multiplied by V in one pass over the
distributed vectors: each task adds up X'(XQ) of its centred rows, and only these small sums are shuffled. A polynomial of V, by
the three-term recurrence of such passes, damps the spectrum that isn't wanted; then QR makes the block orthonormal again and
Rayleigh-Ritz reads off eigenvalues and vectors. It ends when the residuals |Vq - eq| certify every wanted pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, staged, unstage

SCALE, SHIFT = 64.0, 1_000_000
#: Residual of a certified pair, and of one that rounding lets come no nearer, over the largest eigenvalue.
CERTIFIED, ROUNDED = 1e-14, 1e-11
#: Passes of a filter at most; how much more it may raise the largest eigenvalue than the last wanted one; filters at most.
DEGREE, GROWTH, FILTERS = 12, 1e8, 80
#: Passes of one vector that look for the lower end of the spectrum.
FEELERS = 6
#: Eigenvalues under this share of the largest are none: the vectors don't spread that way.
NOTHING = 1e-12
SEED = 17


class Centre(NamedTuple):
    """Of a fit list: how many vectors, and the exact sums by dimension (as whole parts of the mean, and what these leave over)."""

    n: int
    whole: np.ndarray
    left: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / self.n


class Whitening(NamedTuple):
    """Of vectors of one length: their centre, components (columns) by falling eigenvalue, the trace, and the measured error."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def usable(vector: Column) -> Column:
    """Not null, with at least one entry, and no entry that is null, not finite, or too large for a bigint when scaled."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(1 << 56))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd)


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers floor(64 c) + 1000000 of the entries, of the rows with usable vectors."""
    own = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")).where(usable(F.col("c")))
    return own.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x"))


def matrix(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), d)


def added_up(fit: DataFrame, d: int, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what kernel makes of a batch of them: one pass, a row for each task and cell shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel(), pa.float64())], ["cell", "value"])

    ship(fit.sparkSession)
    found = fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # a row a cell
    out = np.zeros(found.num_rows)
    out[found["cell"].to_numpy()] = found["value"].to_numpy()
    return out


def exact_sums(fit: DataFrame, d: int) -> list[int]:
    """The sum of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), d)
            high, low = x >> 24, x & 0xFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high.sum(0)), pa.array(low.sum(0))], ["cell", "high", "low"])

    ship(fit.sparkSession)
    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = fit.mapInArrow(run, "cell int, high bigint, low bigint").groupBy("cell").agg(big("high"), big("low")).collect()  # a row a dimension
    return [(int(r["high"]) << 24) + int(r["low"]) for r in sorted(rows, key=lambda r: r["cell"])]


def centre_of(fit: DataFrame, d: int) -> Centre:
    n, sums = fit.count(), exact_sums(fit, d)
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues of V in the space of q, falling; their vectors; V times these)."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def _floor_of(apply: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator) -> float:
    """About the smallest eigenvalue, or less: a few Lanczos steps from a random vector."""
    basis = [v := rng.standard_normal(d) / math.sqrt(d)]
    basis[0] = v / np.linalg.norm(v)
    images = []
    for k in range(min(FEELERS, d)):
        images.append(apply(basis[k][:, None])[:, 0])
        rest = images[k]
        for _ in range(2):
            rest = rest - sum((b @ rest) * b for b in basis)
        if k + 1 == min(FEELERS, d) or np.linalg.norm(rest) <= 1e-12 * np.linalg.norm(images[k]):
            break
        basis.append(rest / np.linalg.norm(rest))
    values, q, vq = _ritz(np.stack(basis, 1)[:, : len(images)], np.stack(images, 1))
    return max(0.0, float((values - np.linalg.norm(vq - q * values, axis=0)).min()))


def eigenpairs(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the largest `wanted` eigenvalues of V; apply(Q) is VQ, one pass over the vectors.

    A filter T_m of V is scaled so that [low, the block's smallest Ritz value] falls on [-1, 1]. Its degree is as high as GROWTH
    lets the largest eigenvalue outgrow the wanted ones, or the columns would all turn to the first vector. RuntimeError if the
    residuals stay above ROUNDED.
    """
    rng, block = np.random.default_rng(SEED), min(d, 2 * wanted)
    if block == d:
        values, q, _ = _ritz(np.eye(d), apply(np.eye(d)))
        return values[:wanted], q[:, :wanted]
    low = _floor_of(apply, d, rng)
    q = np.linalg.qr(rng.standard_normal((d, block)))[0]
    best, since, kept = math.inf, 0, None
    for _ in range(FILTERS):
        values, q, vq = _ritz(q, apply(q))
        top = max(float(values[0]), 0.0)
        worst = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max())
        if worst < best / 2:
            since = 0
        else:
            since += 1
        if worst < best:
            best, kept = worst, (values[:wanted].copy(), q[:, :wanted].copy())
        if best <= CERTIFIED * top or since >= 3 and best <= ROUNDED * top:
            break
        if since >= 3:
            low, since = 0.0, 0  # the lower end was taken too high
        high = float(values[-1])
        half = max((high - low) / 2, 1e-6 * top)
        middle = high - half
        reach = lambda x: math.acosh(max(1.0, (x - middle) / half))  # noqa: B023, E731
        degree = int(min(DEGREE, max(2, math.log(GROWTH) / max(1e-9, reach(top) - reach(float(values[wanted - 1]))))))
        rate = half / (top - middle)
        before, now, r = q, (vq - middle * q) * (rate / half), rate
        for _ in range(1, degree):
            following = 1 / (2 / rate - r)
            before, now, r = now, (apply(now) - middle * now) * (2 * following / half) - r * following * before, following
        q = np.linalg.qr(now)[0]
    if best > max(ROUNDED * top, np.finfo(float).tiny):
        raise RuntimeError(f"no certified eigenvectors: a residual of {best / max(top, np.finfo(float).tiny):.1e}")
    return kept


def fit_whitening(fit: DataFrame, d: int, wanted: int) -> Whitening:
    """fit: one column x, distinct vectors of length d, staged."""
    centre = centre_of(fit, d)
    trace = float(added_up(fit, d, lambda x: (centre.centred(x) ** 2).sum(keepdims=True))[0]) / centre.n

    def apply(q: np.ndarray) -> np.ndarray:
        def kernel(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ q)

        return added_up(fit, d, kernel).reshape(d, q.shape[1]) / centre.n

    values, vectors = eigenpairs(apply, d, min(d, wanted)) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    some = values > NOTHING * (values[0] if len(values) else 0)
    values, vectors = values[some], vectors[:, some]
    k = len(values)
    if not k:
        return Whitening(centre, vectors, values, trace, 0.0)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])

    def squares(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ vectors / np.sqrt(values)
        return w.T @ w

    error = float(np.abs(added_up(fit, d, squares).reshape(k, k) / centre.n - np.eye(k)).max())
    return Whitening(centre, vectors, values, trace, error)


def deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exactly; None where a bigint can't hold it."""
    off = x - centre.whole
    most = centre.n * (int(np.abs(off).max(initial=0)) + 1)
    if most**2 * x.shape[1] < 1 << 63:
        return ((centre.n * off - centre.left) ** 2).sum(1).tolist()
    exact = ((centre.n * off.astype(object) - centre.left.astype(object)) ** 2).sum(1).tolist()
    return [e if e < 1 << 63 else None for e in exact]


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row and leading component.

    Rows whose vector is null, empty, or has a null or non-finite entry (or one of 2^56 or more, whose scaled value no exact sum
    takes) are left out; a null vec_id and repeated rows stay. Entries c are taken as x = floor(64 c) + 1000000. The fit list is
    each distinct vector once, however often it is repeated; vectors of different lengths are fitted apart. Directions without
    spread have no component, so a length with a single distinct vector gives no row. deviation is null where a bigint can't hold
    it. Other columns are left out. Vectors are shuffled once, to tell distinct ones, with equal ones combined before; a
    pass shuffles a few numbers for each task and broadcasts the block.
    """
    rows = scaled(embeddings)
    lengths = [r["d"] for r in rows.groupBy(F.size("x").alias("d")).count().orderBy("d").collect()]  # a row a length
    out = None
    for d in lengths:
        own = rows.where(F.size("x") == d)
        fit = staged(own.select("x").distinct(), "whitening-fit")
        w = fit_whitening(fit, d, components)
        unstage(fit)
        part = apply_whitening(own, w)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else embeddings.sparkSession.createDataFrame([], SCHEMA)


def apply_whitening(rows: DataFrame, w: Whitening) -> DataFrame:
    """rows: vec_id and x, of the length that w was fitted to."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(w)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k, basis = len(w.values), w.components / np.sqrt(w.values)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column(1), len(w.centre.whole))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, w.centre.n, np.int64)), pa.array(deviations(x, w.centre), pa.int64()).take(each),
                pa.array((w.centre.centred(x) @ basis).ravel()), pa.array(np.tile(w.values / w.trace, len(x))), pa.array(np.full(m, w.identity_error)),
            ], names)

    return rows.mapInArrow(run, SCHEMA)
