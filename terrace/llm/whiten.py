"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import map_batches, written
from terrace.llm.vectors import Shape, packed, shape_of, unpacked

#: Components that are returned, at most.
COMPONENTS = 4
SEED = 20_011
#: Relative sizes under which a coefficient counts as zero (the space is used up) and a component as flat.
NOTHING, FLAT = 1e-12, 1e-14
LIMB = 1 << 60

Product = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]]


@dataclass(frozen=True)
class Centre:
    """Count and exact sums of the fit list, and its mean as whole and rest."""

    n: int
    sums: tuple[int, ...]
    squares: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, unrounded: the whole part is taken off as integers."""
        whole = [round(Fraction(s, self.n)) for s in self.sums]
        rest = np.array([float(Fraction(s, self.n) - w) for s, w in zip(self.sums, whole, strict=True)])
        if x.dtype == np.int64 and max(map(abs, whole), default=0) >= 1 << 31:
            return (x.astype(object) - np.array(whole, dtype=object)).astype(float) - rest
        return (x.astype(np.int64) - np.array(whole, dtype=np.int64)).astype(float) - rest

    @property
    def trace(self) -> float:
        """Total variance."""
        return float(Fraction(self.n * self.squares - sum(s * s for s in self.sums), self.n * self.n))


def whole_sum(x: np.ndarray, largest: int) -> list[int]:
    """Exact column sums as Python integers."""
    wide = largest * max(1, len(x)) >= 1 << 62
    return [int(v) for v in (x.astype(object) if wide else x.astype(np.int64)).sum(axis=0)] if len(x) else [0] * x.shape[1]


def whole_dot(x: np.ndarray, y: np.ndarray, bound: int) -> np.ndarray:
    """Exact row sums of ``x * y``; ``bound`` limits their size."""
    kind = np.int64 if bound < 1 << 62 else object
    return (x.astype(kind) * y.astype(kind)).sum(axis=1) if x.shape[1] else np.zeros(len(x), kind)


def centre_of(fit: DataFrame, shape: Shape) -> Centre:
    """Exact sums over the fit list: one small row set a task, summed as limbs of 60 bits."""
    dim, kind, largest = shape.dim, shape.kind, shape.largest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dim + 2)
        for batch in batches:
            x = unpacked(batch.column("x"), dim, kind)
            squares = whole_dot(x, x, dim * largest * largest)
            totals = [t + v for t, v in zip(totals, [*whole_sum(x, largest), sum(map(int, squares)), len(x)], strict=True)]
        limbs = [(3 * i + j, Decimal(v)) for i, t in enumerate(totals) for j, v in enumerate((t % LIMB, t // LIMB % LIMB, t // LIMB**2))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in limbs], pa.int32()), pa.array([v for _, v in limbs], pa.decimal128(38, 0))], names=["slot", "value"])

    summed = map_batches(fit, run, "slot int, value decimal(38,0)").groupBy("slot").agg(F.sum("value").cast("string").alias("value"))
    found = {r.slot: int(r.value) for r in summed.collect()}
    totals = [sum(found.get(3 * i + j, 0) * LIMB**j for j in range(3)) for i in range(dim + 2)]
    return Centre(totals[-1], tuple(totals[:dim]), totals[dim])


def summed(fit: DataFrame, shape: Shape, centre: Centre, numbers: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Sum over the centred rows of the vector that ``numbers`` makes of a block of them."""
    dim, kind = shape.dim, shape.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += numbers(centre.centred(unpacked(batch.column("x"), dim, kind)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["slot", "value"])

    rows = map_batches(fit, run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(length)
    for r in rows:
        out[r.slot] = r.value
    return out


def distributed_product(fit: DataFrame, shape: Shape, centre: Centre) -> Product:
    """``product(a, p)``: with ``u = Xa`` and ``U = Xp``, the sums ``U'u``, ``u'u`` and ``X'u`` over all rows."""

    def product(a: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        k, dim = p.shape[1], shape.dim

        def numbers(x: np.ndarray) -> np.ndarray:
            u = x @ a
            return np.concatenate([(x @ p).T @ u, [u @ u], x.T @ u])

        found = summed(fit, shape, centre, numbers, k + 1 + dim)
        return found[:k], float(found[k]), found[k + 1 :]

    return product


def bidiagonalise(product: Product, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``V`` (orthogonal) and upper bidiagonal ``B`` with ``XV = UB``, over the whole space.

    The left vectors, one entry a row of the table, are never stored: each is
    ``X`` times a short vector (a column of ``p``), so a task rebuilds its part
    of all of them. One pass a step gives ``Xv`` taken against all earlier left
    vectors, its length, and ``X'u``; where much had to be taken off, the pass
    is made again. Right vectors are short and are taken against all earlier
    ones twice. A used-up space goes on from a new direction, so equal and zero
    singular values are found as well.
    """
    rng = np.random.default_rng(SEED)
    right, p, g = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    b = np.zeros((dim, dim))

    def off(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    def fresh() -> np.ndarray:
        w = off(rng.standard_normal(dim))
        return w / np.linalg.norm(w)

    v, last, beta, largest = (fresh() if dim else None), np.zeros(dim), 0.0, 0.0
    for k in range(dim):
        right = np.column_stack([right, v])
        a = v - beta * last
        for _ in range(3):
            c, squared, h = product(a, p)
            a, h = a - p @ c, h - g @ c
            left, squared = c @ c > 1e-8 * squared, squared - c @ c
            if not left:
                break
        alpha = np.sqrt(max(squared, 0.0))
        largest = max(largest, alpha, beta)
        if alpha <= NOTHING * largest or alpha == 0:
            alpha, last, h = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            last, h = a / alpha, h / alpha
        p, g, b[k, k] = np.column_stack([p, last]), np.column_stack([g, h]), alpha
        if k + 1 < dim:
            w = off(h - alpha * v)
            beta = float(np.linalg.norm(w))
            largest = max(largest, beta)
            if beta <= NOTHING * largest or beta == 0:
                beta, v = 0.0, fresh()
            else:
                v = w / beta
            b[k, k + 1] = beta
    return right, b


def principal(product: Product, dim: int, n: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit components (as columns) and variances by falling variance; flat ones are left out."""
    right, b = bidiagonalise(product, dim)
    if not dim:
        return right, np.zeros(0)
    _, sizes, turned = np.linalg.svd(b)
    variances = sizes**2 / max(n, 1)
    kept = min(wanted, int((variances > FLAT * variances[0]).sum()))
    return right @ turned.T[:, :kept], variances[:kept]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for rows ``vec_id, x`` of integer vectors.

    The fit list is each distinct vector once. ``whitened`` is the centred
    vector along a unit component of the list's covariance, over the square
    root of its variance; ``explained`` that variance over the total one;
    ``deviation`` the exact sum over dimensions of ``(n * x - S)**2`` (null
    beyond the range of a long); ``identity_error`` the largest entry of the
    whitened list's covariance less the identity.

    Shorter vectors end in zeros. Repeated rows each get their results and
    count once in the fit. Components without variance are left out, so equal
    vectors, empty vectors and an empty table give no rows. Components of
    equal variance may be any basis of their space, the same for all rows.
    Null ids stay null. Other columns play no part, whatever their names.
    """
    rows = rows.select("vec_id", "x")
    shape = shape_of(rows)
    table = written(packed(rows, shape), "vectors")
    fit = written(table.select("x").distinct(), "fit")
    centre = centre_of(fit, shape)
    dim, kind, n = shape.dim, shape.kind, centre.n
    basis, variances = principal(distributed_product(fit, shape, centre), dim if n > 1 else 0, n, components)
    if n <= 1:
        basis = np.zeros((dim, 0))
    count = len(variances)
    turn = basis / np.sqrt(variances)
    error = identity_error(fit, shape, centre, turn) if count else 0.0
    explained = variances / centre.trace if count else variances
    sums = np.array(centre.sums, dtype=object)
    far = max(map(abs, centre.sums), default=0)
    total = sum(s * s for s in centre.sums)
    largest = shape.largest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("x"), dim, kind)
            squares = whole_dot(x, x, dim * largest * largest)
            along = whole_dot(x, np.broadcast_to(sums, x.shape), dim * largest * far)
            if 4 * n * n * dim * max(1, largest) ** 2 + 4 * n * dim * largest * far + total < 1 << 62:
                off = n * n * squares.astype(np.int64) - 2 * n * along.astype(np.int64) + total
            else:
                off = [v if v < 1 << 63 else None for v in n * n * squares.astype(object) - 2 * n * along.astype(object) + total]
            scores = centre.centred(x) @ turn
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n, dtype=np.int64)),
                pa.array(off, pa.int64()).take(pa.array(each)), pa.array(scores.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind_of_id = dict(rows.dtypes)["vec_id"]
    return map_batches(table, run, f"vec_id {kind_of_id}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def identity_error(fit: DataFrame, shape: Shape, centre: Centre, turn: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity."""
    k = turn.shape[1]

    def numbers(x: np.ndarray) -> np.ndarray:
        z = x @ turn
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = summed(fit, shape, centre, numbers, k + k * k) / centre.n
    return float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
