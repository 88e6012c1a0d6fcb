"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of trial vectors Q is multiplied by it in
passes over the rows, ``(1/n) Σ c (cᵀ Q)`` with every row centred before it is
multiplied; each partition sends one partial product of (dimensions x block) numbers,
summed in Spark. Between passes the driver holds such blocks only: a polynomial
recurrence damps the spectrum below the block, QR makes the block orthonormal again,
Rayleigh-Ritz reads eigenpairs off it, and the residuals |V q - e q| certify them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import cut_lineage

SCALE = 1024
SHIFT = 100_000
#: Trial vectors beyond the wanted ones; they set where the unwanted spectrum begins.
GUARDS = 24
#: Highest degree of one filter.
DEGREE = 12
#: A residual of this share of the largest eigenvalue certifies a pair.
TOLERANCE = 1e-13
#: Rounding can hold residuals above that; where they no longer fall, this share will do.
ACCEPTED = 1e-10
CYCLES = 200


@dataclass(frozen=True)
class Moments:
    """Rows, and per dimension the exact sum of x."""

    n: int
    sums: list[int]

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole part and remainder: x - mean = (x - whole) - rest / n."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, whole, strict=True)], np.int64)


@dataclass(frozen=True)
class Basis:
    """Unit eigenvectors as columns, their eigenvalues falling, and what certifies them."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    passes: int
    block: int


def whole_numbers(rows: DataFrame, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the kept columns) beside ``x``, the vector as whole numbers.

    Rows whose vector is NULL or holds a NULL, NaN or infinite entry are left out.
    """
    names = rows.columns if keep is None else keep
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    # a condition on a NULL vector is NULL, which drops the row too
    return rows.where(~bad).select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"),
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; a shorter row goes on with the x of 0.0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.full((len(sizes), dims), SHIFT, np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def moments(stored: DataFrame) -> Moments:
    """Exact count and sums. The longest vector gives the dimensions."""

    def run(batches):
        n, sums = 0, np.zeros(0, np.int64)
        for batch in batches:
            sizes = np.diff(batch.column("x").offsets.to_numpy())
            if len(sizes) == 0:
                continue
            dims = max(len(sums), int(sizes.max()))
            total = _matrix(batch.column("x"), dims).sum(axis=0)
            # earlier rows of this partition go on with the x of 0.0
            sums = np.concatenate([sums, np.full(dims - len(sums), n * SHIFT, np.int64)]) + total
            n += len(sizes)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(-1, len(sums)), pa.int32()), "s": pa.array([0, *sums.tolist()], pa.int64()), "n": pa.array([n] * (len(sums) + 1), pa.int64())}
            )

    found = stored.select("x").mapInArrow(run, "i int, s long, n long")
    sums = found.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    at = {r.i: r for r in sums}
    if -1 not in at:
        return Moments(0, [])
    n = at[-1].n
    # partitions that know no vector of this length hold n - at[i].n rows
    return Moments(n, [int(at[i].s) + (n - at[i].n) * SHIFT for i in range(len(at) - 1)])


def _summed(stored: DataFrame, about: Moments, size: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``fn`` of a batch's centred rows, a matrix with ``size`` columns."""
    whole, rest = about.centre()
    n, dims = about.n, about.dims

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn((_matrix(batch.column("x"), dims) - whole) - rest / n)
                total = part if total is None else total + part
        if total is not None:
            offsets = pa.array(np.arange(0, total.size + 1, size), pa.int32())
            rows = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(total).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), rows], names=["i", "v"])

    parts = stored.select("x").mapInArrow(run, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((i.max() + 1, size))
    out[i, j] = v
    return out


def _filter_degree(values: np.ndarray, wanted: int, edge: float) -> int:
    """The highest degree at which the first pair grows at most a million times as much as the last wanted one."""
    place = 2 * values[[0, wanted - 1]] / edge - 1
    high, low = np.arccosh(np.maximum(place, 1.0))
    for degree in range(DEGREE, 1, -1):
        if degree * (high - low) <= math.log(1e6):
            return degree
    return 1


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guards: int = GUARDS) -> Basis:
    """The ``wanted`` largest eigenpairs of a positive semi-definite matrix known by its products.

    Each cycle costs as many products as its filter's degree. The block grows where
    residuals fall slowly (eigenvalues that hardly differ at its end), at last to all
    dimensions, where Rayleigh-Ritz alone is exact.
    """
    passes, best, slow = 0, math.inf, 0
    block = min(dims, wanted + guards)
    fresh = np.random.default_rng(13)
    q, _ = np.linalg.qr(fresh.standard_normal((dims, block)))
    for _ in range(CYCLES):
        z = apply(q)
        passes += 1
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        residuals = np.linalg.norm(z - q * values, axis=0)
        worst, top = residuals[:wanted].max(), max(values[0], 0.0)
        slow = slow + 1 if worst > best / 10 else 0
        if worst <= TOLERANCE * top or (slow >= 2 or block == dims) and worst <= ACCEPTED * top:
            return Basis(q[:, :wanted], np.maximum(values[:wanted], 0.0), residuals[:wanted], passes, block)
        best = min(best, worst)
        if slow >= 2 and block < dims:
            more = min(dims, 2 * block) - block
            q, _ = np.linalg.qr(np.hstack([q, fresh.standard_normal((dims, more))]))
            block, slow = block + more, 0
            continue
        edge = max(values[-1], 1e-12 * top)
        half = edge / 2
        # recurrence of the scaled Chebyshev polynomial over [0, edge], one product a degree
        sigma = first = half / (top - half)
        before, now = q, (z - half * q) * (first / half)
        for _ in range(_filter_degree(values, wanted, edge) - 1):
            after = 1 / (2 / first - sigma)
            product = apply(now)
            passes += 1
            before, now = now, 2 * (after / half) * (product - half * now) - sigma * after * before
            sigma = after
        q, _ = np.linalg.qr(now)
    raise RuntimeError(f"residual {best:.3g} of eigenvalue {top:.6g} after {CYCLES} cycles")


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of the fit list, and how well it does there."""

    about: Moments
    basis: Basis
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        """Components as columns; 0 for a component without variance."""
        e = self.basis.values
        live = e > 1e-12 * max(self.trace, 1e-300)
        return self.basis.vectors * np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), 0.0)


def fit(stored: DataFrame, components: int = 8, guards: int = GUARDS) -> Whitening | None:
    """Whitening of all rows of ``stored`` (see ``whole_numbers``); None where there are none."""
    about = moments(stored)
    if about.n == 0 or about.dims == 0:
        return None
    dims, n = about.dims, about.n

    def apply(q: np.ndarray) -> np.ndarray:
        return _summed(stored, about, q.shape[1], lambda c: c.T @ (c @ q)) / n

    trace = float(_summed(stored, about, 1, lambda c: np.array([[np.square(c).sum()]]))[0, 0]) / n
    basis = leading_pairs(apply, dims, min(components, dims), guards)
    found = Whitening(about, basis, trace, 0.0)
    weights = found.weights
    live = np.flatnonzero(np.abs(weights).sum(axis=0))
    error = 0.0
    if len(live):
        # the centred rows sum to zero exactly, so do the whitened ones
        spread = _summed(stored, about, len(live), lambda c: (c @ weights[:, live]).T @ (c @ weights[:, live])) / n
        error = float(np.abs(spread - np.eye(len(live))).max())
    return Whitening(about, basis, trace, error)


def _deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact at any size."""
    off = x - whole
    if len(off) and x.shape[1] * (n * int(np.abs(off).max(initial=0)) + n) ** 2 >= 2**63:
        return [int(v) for v in ((n * off.astype(object) - rest.astype(object)) ** 2).sum(axis=1)]
    return np.square(n * off - rest).sum(axis=1).tolist()


def whiten(rows: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = 8) -> DataFrame:
    """``row``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` per row and component.

    An entry c counts as floor(1024 c) + 100000. Rows whose vector is NULL or holds a
    NULL, NaN or infinite entry are dropped; all others, repeats included, are fitted
    and returned. Vectors shorter than the longest one go on with 0.0; where all are
    empty, and for an empty table, there are no rows. With fewer than ``components``
    dimensions there is a component for each. A component without variance has
    ``whitened`` 0, and ``explained`` is 0 where nothing varies. ``deviation`` is exact;
    where it is beyond a long (about 100 million rows) it is NULL and
    ``deviation_text`` has its digits. An entry beyond 2^42 ends the job with an error.
    The kept columns stay in ``row``, whatever they are called.
    """
    stored = cut_lineage(whole_numbers(rows, vector, keep))
    model = fit(stored, components)
    schema = T.StructType(
        [
            stored.schema["row"],
            T.StructField("deviation", T.LongType()),
            T.StructField("deviation_text", T.StringType()),
            T.StructField("w", T.ArrayType(T.DoubleType())),
        ]
    )
    if model is None:
        found = stored.where(F.lit(False)).select(
            "row", F.lit(None).cast("long").alias("deviation"), F.lit("").alias("deviation_text"), F.array(F.lit(0.0)).alias("w")
        )
        n, explained, error = 0, [0.0], 0.0
    else:
        about, weights = model.about, model.weights
        whole, rest = about.centre()
        n, dims, error = about.n, about.dims, model.identity_error
        explained = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.basis.values]
        size = weights.shape[1]

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("x"), dims)
                exact = _deviations(x, n, whole, rest)
                w = ((x - whole) - rest / n) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, size), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        pa.array([v if v < 2**63 else None for v in exact], pa.int64()),
                        pa.array([str(v) for v in exact]),
                        lists,
                    ],
                    names=["row", "deviation", "deviation_text", "w"],
                )

        found = stored.mapInArrow(run, schema)
    share = F.array(*[F.lit(e) for e in explained])
    return found.select("row", "deviation", "deviation_text", F.posexplode("w").alias("at", "whitened")).select(
        "row",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_text",
    )
