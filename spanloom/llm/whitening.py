"""Whitening of vectors: leading principal components by Chebyshev-filtered subspace iteration.

The covariance is never built.  Each pass over the table multiplies it with a
thin block: a task adds up ``Xc' (Xc Q)`` of its rows, centred first, and sends
one row per dimension; Spark sums these.  Three-term recurrences of passes damp
the part of the spectrum below the block, then QR and Rayleigh-Ritz turn the
block, until the residuals of the wanted components certify them.  The driver
holds blocks of (dimensions x block width) only, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import kept

SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact long value; their rows are dropped.
ENTRY_LIMIT = float(1 << 40)
#: Columns of the iterated block for each wanted component.
WIDTH = 4
#: Passes of one filter, the pass of Rayleigh-Ritz included.
DEGREE = 10
#: Steps of the Lanczos run that bounds the spectrum from below.
LANCZOS = 8
#: Largest residual of a certified component, relative to the largest eigenvalue.
TOLERANCE = 1e-13
#: A residual that rounding keeps from falling further is accepted up to here.
ACCEPTED = 1e-11
MAX_CYCLES = 60
_SEED = 20
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _complete(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= ENTRY_LIMIT)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda c: bad(c.cast("double"))), F.lit(False))


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows that take part, as a written table; ``x`` are longs.

    Rows with null vectors, null or non-finite entries go; so do empty vectors,
    entries of 2^40 or more (no exact long) and vectors whose length is not the
    most frequent one (of equally frequent lengths the larger).  Null ids stay.
    """
    rows = vectors.filter(_complete(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (usual["d"] if usual else 0))
    return kept(rows.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).cast("array<long>").alias("x")), "whitening-x")


def _block(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(x: DataFrame, d: int, rows: int, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all batches of ``of(batch)``, a matrix of ``rows`` by ``width``: one row per task and matrix row is sent."""
    names = [f"y{j}" for j in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of(_block(b.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]], ["i", *names])

    parts = x.select("x").mapInArrow(task, "i int, " + ", ".join(f"{c} {kind}" for c in names))
    out = np.zeros((rows, width), dtype=np.int64 if kind == "long" else np.float64)
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row per dimension
        out[r["i"]] = [r[c] for c in names]
    return out


class Components:
    """Leading eigenpairs of the covariance of a table of long vectors: ``values`` (falling), ``vectors`` (columns), ``trace``."""

    def __init__(self, x: DataFrame, d: int, wanted: int = 8):
        self.x, self.d, self.passes = x, d, 0
        sums = _summed(x, d, d, 2, lambda m: np.stack([m.sum(axis=0), np.full(d, len(m))], axis=1), "long")
        self.n, self.sums = int(sums[0, 1]), [int(s) for s in sums[:, 0]]
        self.mean = np.array([s / self.n for s in self.sums])
        mean, n = self.mean, self.n
        self.trace = float(_summed(x, d, d, 1, lambda m: ((m - mean) ** 2).sum(axis=0)[:, None]).sum() / n)
        self.values, self.vectors = self._solve(min(wanted, d))

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``: one pass."""
        mean = self.mean

        def of(m: np.ndarray) -> np.ndarray:
            c = m - mean
            return c.T @ (c @ q)

        self.passes += 1
        return _summed(self.x, self.d, self.d, q.shape[1], of) / self.n

    def _floor(self) -> float:
        """A lower bound of the spectrum from a short Lanczos run: smallest Ritz value less the last residual."""
        v = np.random.default_rng(_SEED + 1).standard_normal(self.d)
        basis, alpha, beta = [v / np.linalg.norm(v)], [], []
        for _ in range(min(LANCZOS, self.d)):
            w = self.times(basis[-1][:, None])[:, 0]
            alpha.append(float(basis[-1] @ w))
            for _ in range(2):  # orthogonal to all earlier ones, to the last digit
                w = w - np.stack(basis, axis=1) @ (np.stack(basis) @ w)
            beta.append(float(np.linalg.norm(w)))
            if beta[-1] <= 1e-12 * self.trace:
                beta[-1] = 0.0
                break
            basis.append(w / beta[-1])
        k = len(alpha)
        t = np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beta[k - 1])

    def _solve(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        d, width = self.d, min(self.d, WIDTH * wanted)
        q = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((d, width)))[0]
        if self.trace == 0.0:
            return np.zeros(wanted), q[:, :wanted]
        low = self._floor() if width < d else 0.0
        w = self.times(q)
        best, still = np.inf, 0
        for _ in range(MAX_CYCLES):
            h = q.T @ w
            values, turn = np.linalg.eigh((h + h.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            q, w = q @ turn, w @ turn
            residual = np.linalg.norm(w - q * values, axis=0)[:wanted].max() / values[0]
            still = 0 if residual < best / 2 else still + 1
            best = min(best, residual)
            if residual <= TOLERANCE or (still >= 2 and residual <= ACCEPTED):
                return values[:wanted].clip(min=0.0), q[:, :wanted]
            q = np.linalg.qr(self._filtered(q, w, low, values))[0]
            w = self.times(q)
        raise RuntimeError(f"components are not certified after {MAX_CYCLES} filters: residual {best:.2e}")

    def _filtered(self, q: np.ndarray, w: np.ndarray, low: float, values: np.ndarray) -> np.ndarray:
        """Chebyshev polynomial of the covariance on ``q``, small between ``low`` and the smallest Ritz value.

        ``w`` is the covariance times ``q``; the recurrence is scaled to be one at the largest Ritz value.
        """
        high = max(float(values[-1]), low + 1e-9 * float(values[0]))
        half, middle = (high - low) / 2, (high + low) / 2
        first = half / (float(values[0]) - middle) if values[0] > middle else 1.0
        sigma, before = first, q
        y = (w - middle * q) * (sigma / half)
        for _ in range(DEGREE - 2):
            after = 1 / (2 / first - sigma)
            y, before = (self.times(y) - middle * y) * (2 * after / half) - sigma * after * before, y
            sigma = after
        return y


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; None where no long holds it."""
    rough = ((n * x.astype(np.float64) - np.array(sums, dtype=np.float64)) ** 2).sum(axis=1)
    fits = (rough < 9e18) & (np.abs(x).max(axis=1).astype(np.float64) * n < 4e18)
    out: list[int | None] = [None] * len(x)
    if fits.any():
        far = n * x[fits] - np.array(sums, dtype=np.int64)
        for i, v in zip(np.flatnonzero(fits).tolist(), (far * far).sum(axis=1).tolist(), strict=True):
            out[i] = v
    for i in np.flatnonzero(~fits).tolist():
        v = sum((n * int(c) - s) ** 2 for c, s in zip(x[i].tolist(), sums, strict=True))
        out[i] = v if v < 1 << 63 else None
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """Coordinates of every complete vector on the leading components, scaled to unit variance.

    One row per vector and component.  Rows that take part: see
    :func:`integer_vectors`; repeated rows count and come back as often as they
    occur.  Components are numbered by falling eigenvalue, equal ones in the order
    found; their sign is arbitrary and the same for all rows.  A component without
    variance (less than 1e-14 of the trace) has ``whitened`` null and takes no part
    in ``identity_error``; so has each one of a table of equal vectors.  ``deviation``
    is null where a long cannot hold it.  An empty table gives an empty one.
    """
    x = integer_vectors(vectors, id_col, vec_col)
    one = x.select(F.size("x").alias("d")).first()
    if one is None:
        return x.sparkSession.createDataFrame([], _SCHEMA)
    d = one["d"]
    found = Components(x, d, components)
    n, sums, mean, k = found.n, found.sums, found.mean, len(found.values)
    there = found.values > 1e-14 * found.trace
    scaled = found.vectors / np.sqrt(np.where(there, found.values, 1.0))
    share = [float(v / found.trace) if found.trace else 0.0 for v in found.values]

    def second(m: np.ndarray) -> np.ndarray:
        z = (m - mean) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    moments = _summed(x, d, k + 1, k, second) / n
    gap = np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k))
    error = float(gap[np.ix_(there, there)].max()) if there.any() else 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _block(b.column(1), d)
            if not len(m):
                continue
            z = (m - mean) @ scaled
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(m)), k)))
            deviation = pa.array(_deviations(m, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(m)), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(m) * k, n)), deviation,
                    pa.array(z.reshape(-1), mask=np.tile(~there, len(m))), pa.array(np.tile(share, len(m))), pa.array(np.full(len(m) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select("vec_id", "x").mapInArrow(rows, _SCHEMA)
