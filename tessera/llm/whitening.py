"""Whitening of embeddings onto their leading principal components, by matrix-free block Lanczos.

1. Entries become whole numbers, floor(256 c). Each distinct vector of these is in the fit list once:
   a grouping by the vector, combined before it is shuffled, so copies of one vector never meet in a task.
2. Lanczos works with a block of BLOCK vectors. One pass over the fit list multiplies the centred list by
   the block and its transpose by the outcome: every task sums its own products, so a task sends no more
   than the block, and the covariance itself is never formed. Each new block is orthogonalised twice
   against all earlier ones. Directions in which a block breaks down are replaced by fresh ones, orthogonal to
   all before. It ends when the residuals of the leading pairs are below TOLERANCE of the
   largest eigenvalue, or the basis is the whole space.
3. One more pass measures the pairs found, their true residuals and the covariance of the whitened list. If
   residuals are above CHECKED, Lanczos begins anew from the pairs found (at most RESTARTS times).
   The trace comes from the deviations of the vectors from their mean, summed in the first pass.

The driver holds the basis alone: at most d x d numbers for vectors of d entries, whatever the rows.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; vectors
shorter than the longest are continued with zeros; whole numbers stop at the range of a long, and a
deviation beyond it is null; components without variance are left out, so one distinct vector alone, or none, gives
no rows; rows that share a vec_id, or have none, are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
COMPONENTS = 4
BLOCK = 16
#: Of the largest eigenvalue: the residual at which Lanczos ends, the one that its outcome may have, and how often it begins anew.
TOLERANCE, CHECKED, RESTARTS = 1e-15, 1e-12, 3
#: Vectors multiplied at a time.
ROWS = 4096
#: Deviations below it are exact in 64 bits; the few between the two are computed without bound.
SAFE, LONGEST = 2.0**63 * (1 - 1e-9), 2**63 - 1

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """The fit list's number of distinct vectors, entries of each, and sums; components as columns, by falling eigenvalue."""

    n: int
    d: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def whole(vector: Column) -> Column:
    """The entries as whole numbers, floor(256 c); null where the vector is not usable."""
    limit = F.lit(2.0**63)
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, -limit), limit))
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(vector.isNotNull() & usable, F.transform(vector, entry))


def chunks(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The vectors of a column as rows of d whole numbers, up to ROWS at a time."""
    for begin in range(0, len(column), ROWS):
        part = column.slice(begin, ROWS)
        sizes = part.value_lengths().to_numpy(zero_copy_only=False)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        if (sizes == d).all():
            yield flat.reshape(len(part), d)
        else:
            out = np.zeros((len(part), d), dtype=np.int64)
            out[np.arange(d) < sizes[:, None]] = flat
            yield out


def wrapped(sums: list[int]) -> np.ndarray:
    """Whole numbers of any size modulo 2^64, as longs."""
    return np.array([s % 2**64 for s in sums], dtype=np.uint64).view(np.int64)


def means(n: int, sums: list[int]) -> np.ndarray:
    return np.array([s / n for s in sums], dtype=np.float64)


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of their entries: halves of 32 bits are summed apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, [0] * d, [0] * d
        for batch in batches:
            for x in chunks(batch.column("x"), d):
                count += len(x)
                high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist(), strict=True)]
                low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([count, *high], pa.int64()), pa.array([0, *low], pa.int64())], names=["k", "high", "low"])

    whole_sum = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = fit.mapInArrow(task, "k int, high long, low long").groupBy("k").agg(whole_sum("high").alias("high"), whole_sum("low").alias("low")).collect()
    found = {r.k: int(r.high) * 2**32 + int(r.low) for r in rows}
    return found.get(-1, 0) // 2**32, [found.get(k, 0) for k in range(d)]


def summed(fit: DataFrame, d: int, mean: np.ndarray, shape: tuple[int, int], step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of step(centred vectors) over the fit list. A task adds up its own and sends one matrix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in chunks(batch.column("x"), d):
                total += step(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(shape[0] * shape[1])
    for r in fit.mapInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out.reshape(shape)


def orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(Q, R) with block = Q R but for what lies in basis. Columns that break down become fresh directions, orthogonal to basis and Q, with zero in R."""
    d, b = block.shape
    q, r = np.zeros((d, 0)), np.zeros((0, b))
    for j in range(b):
        if basis.shape[1] + q.shape[1] == d:
            break
        v, fresh = block[:, j].copy(), False
        while True:
            for _ in range(2):
                v -= basis @ (basis.T @ v)
                v -= q @ (q.T @ v)
            size = np.linalg.norm(v)
            if size > (1e-6 if fresh else d * np.finfo(float).eps * scale):
                break
            v, fresh = rng.standard_normal(d), True
            v /= np.linalg.norm(v)
        q = np.column_stack([q, v / size])
        row = q[:, -1] @ block
        row[:j] = 0
        r = np.vstack([r, np.zeros(b) if fresh else row])
    return q, r


def lanczos(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, wanted: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues, falling, and their vectors, of the symmetric matrix of which times gives the product with a block."""
    d = len(start)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    block, _ = orthonormal(start, basis, 1.0, rng)
    while True:
        image = times(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        t = basis.T @ images
        values, inner = np.linalg.eigh((t + t.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        scale = max(float(values[0]), 0.0)
        if basis.shape[1] == d:
            break
        block, r = orthonormal(image, basis, scale, rng)
        # What a Ritz pair's image has outside of the basis: the coupling to the next block, at its last entries.
        residuals = np.linalg.norm(r @ inner[-r.shape[1] :], axis=0)
        if len(values) == wanted and residuals.max() <= TOLERANCE * scale:
            break
    vectors = np.linalg.qr(basis @ inner)[0]
    return values, vectors * np.sign(np.sum(vectors * (basis @ inner), axis=0))


def fitted(fit: DataFrame, d: int, wanted: int = COMPONENTS) -> Fit:
    """The leading components of the fit list (x, an array of longs)."""
    n, sums = totals(fit, d)
    none = Fit(n, d, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 1)
    if not n or not d:
        return none
    mean, rng, passes = means(n, sums), np.random.default_rng(0), 1
    wanted, trace = min(wanted, d), None

    def times(block: np.ndarray) -> np.ndarray:
        """The covariance's product with a block. The first pass sums the squared deviations too."""
        nonlocal trace, passes
        passes += 1
        if trace is None:
            both = summed(fit, d, mean, (d + 1, block.shape[1]), lambda x: np.vstack([x.T @ (x @ block), np.full((1, block.shape[1]), np.sum(x * x))]))
            trace = both[-1, 0] / n
            return both[:-1] / n
        return summed(fit, d, mean, block.shape, lambda x: x.T @ (x @ block)) / n

    start = rng.standard_normal((d, min(d, max(BLOCK, wanted))))
    for _ in range(1 + RESTARTS):
        values, vectors = lanczos(times, start, wanted, rng)
        # Below this share of the trace a component is rounding error.
        good = values > d * np.finfo(float).eps * trace
        values, vectors = values[good], vectors[:, good]
        if not len(values):
            return none
        size = np.sqrt(values)

        def check(x: np.ndarray, vectors: np.ndarray = vectors, size: np.ndarray = size) -> np.ndarray:
            w = x @ vectors
            return np.vstack([x.T @ w, (w / size).T @ (w / size), (w / size).sum(axis=0)])

        passes += 1
        seen = summed(fit, d, mean, (d + len(values) + 1, len(values)), check) / n
        image, inner, middle = seen[:d], seen[d:-1], seen[-1]
        residuals = np.linalg.norm(image - vectors * values, axis=0)
        if residuals.max() <= CHECKED * values[0]:
            break
        start = np.column_stack([vectors, rng.standard_normal((d, start.shape[1] - len(values)))])
    error = float(np.abs(inner - np.outer(middle, middle) - np.eye(len(values))).max())
    return Fit(n, d, sums, vectors, values, trace, error, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n x - sums)^2 of every row. Longs wrap around, which cancels where the outcome is a long; null beyond."""
    about = ((x * float(n) - np.array(sums, dtype=np.float64)) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        apart = x * wrapped([n])[0] - wrapped(sums)
        exact = (apart * apart).sum(axis=1)
    out = [v if a < SAFE else None for v, a in zip(exact.tolist(), about.tolist(), strict=True)]
    for i in np.flatnonzero((about >= SAFE) & (about < 2.0**63 * (1 + 1e-9))).tolist():
        value = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums, strict=True))
        out[i] = value if value <= LONGEST else None
    return out


def projector(fit: Fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, explained = means(fit.n, fit.sums), fit.values / fit.trace
        for batch in batches:
            at = 0
            for x in chunks(batch.column("x"), fit.d):
                m, ids = len(x), batch.column("vec_id").slice(at, len(x))
                at += m
                whitened = (x - mean) @ fit.vectors / np.sqrt(fit.values)
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(again),
                    pa.array(whitened.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(distinct vectors x of whole numbers, all of d entries; d) of the rows (vec_id, x)."""
    fit = materialize(vectors.select("x").distinct(), "whitening-fit")
    low, d = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low is not None and low < d:
        longer = F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x")))
        fit = materialize(fit.select(longer.alias("x")).distinct(), "whitening-fit")
    return fit, d or 0


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """RESULT of every usable row of embeddings and each of the leading components."""
    vectors = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), whole(embeddings["embedding"]).alias("x")).filter("x IS NOT NULL")
    fit, d = fit_list(vectors)
    found = fitted(fit, d, wanted)
    if not len(found.values):
        return vectors.limit(0).mapInArrow(projector(found), RESULT)
    return vectors.mapInArrow(projector(found), RESULT)
