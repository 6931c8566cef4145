"""Embedding whitening: components by QDWH spectral divide-and-conquer, applied to every row from a broadcast.

Spark gives the exact integer sums of the vectors and the moments about their rounded
mean; the covariance (dimension x dimension, the only thing the driver holds) follows from
both.  *Divide and conquer.*  The mean of a symmetric matrix's eigenvalues (trace over
size) lies between them.  The polar factor of the matrix shifted by it has eigenvalue 1
where the matrix lies above the shift and -1 below, so ``(U + I) / 2`` is the projector on
the upper invariant subspace.  Both subspaces are split again in the same way, the upper
one first, until a part is one-dimensional or a multiple of the identity; parts below the
wanted components are left.  Polar factors come from the QR form of the dynamically weighted
Halley iteration, which needs no inverse.

*Defined results.*  Vectors that are null or empty, hold null, NaN or infinite entries, or are not of
the most frequent length (of equally frequent ones the shortest) are left out.
Entries are clipped to +-2^40 after scaling.  Rows that repeat count each.  Components
without variance (at most 1e-13 of the largest) have ``whitened`` 0, and ``identity_error`` does not
cover them; with no variance at all ``explained`` is 0.  ``deviation`` is null where it does not
fit a long, ``deviation_exact`` where it has more than 38 digits.  Columns beside the id and the vector
are left out.  No vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid of the exact arithmetic: an entry c becomes floor(SCALE * c) + OFFSET.
SCALE = 1024
OFFSET = 100_000
CLIP = 1 << 40
#: Rows of one block of a task's arrays.
ROWS = 4096
NO_VARIANCE = 1e-13


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    #: one row a component, by falling eigenvalue
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    #: largest absolute entry of the whitened rows' covariance less the identity
    identity_error: float


def polar(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by the QR form of the weighted Halley iteration."""
    d = len(a)
    x = a / np.linalg.norm(a)
    low = 1e-15
    for _ in range(rounds):
        t = np.cbrt(4 * (1 - low**2) / low**4)
        p = np.sqrt(1 + t) + 0.5 * np.sqrt(max(0.0, 8 - 4 * t + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + t))))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(d)]))[0]
        nxt = (q / r) * x + (p - q / r) / np.sqrt(r) * both[:d] @ both[d:].T
        nxt = (nxt + nxt.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        moved = np.linalg.norm(nxt - x)
        x = nxt
        if moved < 1e-13 * d and abs(1 - low) < 1e-13:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces of ``a`` above and below ``shift``."""
    d = len(a)
    for nudge in (0, 1e-3, -2e-3, 5e-3, -1e-2):  # a shift that is an eigenvalue has no sign there
        above = (polar(a - (shift + nudge * np.linalg.norm(a - shift * np.eye(d))) * np.eye(d)) + np.eye(d)) / 2
        if np.linalg.norm(above @ above - above) < 1e-8:
            break
    k = int(round(np.trace(above)))
    start = above @ np.random.default_rng(d).normal(size=(d, k))
    basis = np.linalg.qr(above @ np.linalg.qr(start)[0], mode="complete")[0]
    return basis[:, :k], basis[:, k:]


def top_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, rows of unit eigenvectors) of the ``wanted`` largest eigenvalues of a symmetric matrix."""
    scale = np.linalg.norm(v)
    found: list[np.ndarray] = []
    parts = [np.eye(len(v))]  # bases of subspaces, the uppermost last
    while parts and sum(b.shape[1] for b in found) < wanted:
        basis = parts.pop()
        inner = basis.T @ v @ basis
        inner = (inner + inner.T) / 2
        mean = np.trace(inner) / len(inner)
        if len(inner) == 1 or np.linalg.norm(inner - mean * np.eye(len(inner))) <= 1e-15 * scale:
            found.append(basis)
            continue
        upper, lower = split(inner, mean)
        if not upper.shape[1] or not lower.shape[1]:  # apart by less than rounding
            found.append(basis)
            continue
        parts += [basis @ lower, basis @ upper]
    w = np.concatenate(found, axis=1)[:, : len(v)] if found else np.zeros((len(v), 0))
    w = np.linalg.qr(w)[0]
    e = np.einsum("ij,ik,kj->j", w, v, w)
    order = np.argsort(-e, kind="stable")[:wanted]
    w = w[:, order].T
    sign = np.sign(w[np.arange(len(w)), np.abs(w).argmax(axis=1)])
    return e[order], w * sign[:, None]


def clean(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the usable rows, before lengths are looked at."""
    e = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return e.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & usable)


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x-vectors) of up to ``ROWS`` rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            c = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            yield part.column("vec_id"), np.clip(np.floor(c * SCALE), -CLIP, CLIP).astype(np.int64) + OFFSET


def _summed(df: DataFrame, add: Callable[[np.ndarray], np.ndarray], dimension: int, kind: str) -> np.ndarray:
    """The sum of ``add(x)`` (a flat array of fixed length) over all blocks: one row of sums a task and place, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, dimension):
            part = add(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["part"])

    parts = df.mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("place", "part"))
    wide = F.col("part").cast("decimal(38,0)") if kind == "long" else F.col("part")
    rows = parts.groupBy("place").agg(F.sum(wide).alias("total")).collect()  # as many as ``add`` gives numbers
    return np.array([r.total for r in sorted(rows, key=lambda r: r.place)], dtype=object if kind == "long" else np.float64)


def _white(x: np.ndarray, mean: np.ndarray, rest: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray) -> np.ndarray:
    keep = eigenvalues > NO_VARIANCE * max(eigenvalues.max(initial=0.0), 0.0)
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, eigenvalues, 1.0)), 0.0)
    return ((x - mean) - rest) @ components.T * scale


def _middle(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rounded mean, what the mean has beside it)."""
    mean = [s // n for s in sums]
    return np.array(mean, dtype=np.int64), np.array([(s - m * n) / n for s, m in zip(sums, mean)])


def fit_whitening(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors (``vec_id, embedding``), or None where there are none."""
    good = clean(vectors)
    lengths = good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = lengths.agg(F.max_by(F.struct("d", "n"), F.struct("n", -F.col("d")))).first()[0]
    if best is None:
        return None
    d, n = best.d, best.n
    good = good.filter(F.size("embedding") == d)
    sums = [int(s) for s in _summed(good, lambda x: x.sum(axis=0), d, "long")]
    mean, rest = _middle(n, sums)

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean).astype(np.float64)
        return (y.T @ y).ravel()

    v = _summed(good, moments, d, "double").reshape(d, d) / n - np.outer(rest, rest)
    v = (v + v.T) / 2
    eigenvalues, w = top_components(v, min(components, d))
    k = int((eigenvalues > NO_VARIANCE * eigenvalues.max(initial=0.0)).sum())
    error = 0.0
    if k:

        def squares(x: np.ndarray) -> np.ndarray:
            y = _white(x, mean, rest, w[:k], eigenvalues[:k])
            return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

        total = _summed(good, squares, d, "double") / n
        error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())
    return Whitening(n, sums, w, eigenvalues, float(np.trace(v)), error)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error`` of each usable row and component.

    The model (as many numbers as a component has entries, times components) is broadcast with the task.
    """
    n, sums, w, e = model.n, model.sums, model.components, model.eigenvalues
    d = len(sums)
    mean, rest = _middle(n, sums)
    wide = np.array(sums, dtype=object)

    def deviations(x: np.ndarray) -> pa.Array:
        least = int(np.abs(x).max(initial=0)) * n + max(abs(s) for s in sums)  # bounds |n x - S|
        if least < 1 << 62:
            t = n * x - np.array(sums, dtype=np.int64)
            if int(np.abs(t).max(initial=0)) ** 2 * d < 1 << 63:
                return pa.array((t * t).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        exact = ((n * x.astype(object) - wide) ** 2).sum(axis=1)
        return pa.array([Decimal(k) if k < 10**38 else None for k in exact], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, d):
            y = _white(x, mean, rest, w, e)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([ids, deviations(x), lists], names=["vec_id", "deviation_exact", "white"])

    out = clean(vectors).filter(F.size("embedding") == d).mapInArrow(run, "vec_id long, deviation_exact decimal(38,0), white array<double>")
    out = out.select("vec_id", "deviation_exact", F.posexplode("white").alias("place", "whitened"))
    share = F.array(*[F.lit(float(x / model.trace) if model.trace > 0 else 0.0) for x in e])
    return out.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation_exact as bigint)").alias("deviation"), "deviation_exact",
        "whitened", share[F.col("place")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


SCHEMA = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Fit on all usable vectors and whiten them."""
    model = fit_whitening(vectors, components)
    return vectors.sparkSession.createDataFrame([], SCHEMA) if model is None else whiten(vectors, model)
