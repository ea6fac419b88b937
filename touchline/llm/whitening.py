"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, each distinct one is fitted once. The leading eigenvectors of the covariance
V are found without forming V on the vectors' way: a block Q is multiplied by V in passes over the
centred rows, V Q = X'(X Q) / n, each task adding up its own rows. A Chebyshev polynomial of V, built
by its three-term recurrence from such passes, damps the part of the spectrum below the wanted
values; then Q is made orthonormal again (QR) and rotated to Ritz vectors. This goes on until the
residuals V u - e u of all wanted pairs certify them, or rounding allows no more.

Between passes the driver holds matrices of dimension x block only. The fitted rows lie in the shared
folder as packed blocks, so a lost executor repeats one task's rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import OWN, stored, value_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, OFFSET = 64, 1_000_000
# Larger entries would not be exact as x in double precision.
MAX_ENTRY = float(1 << 45)
COMPONENTS = 16
DEGREE = 10
# Residuals, relative to the largest eigenvalue, that certify the wanted pairs; and what rounding can block.
CERTIFIED, ACCEPTED = 1e-13, 1e-9
MAX_CYCLES = 200
# Eigenvalues below this share of the trace count as zero: their components cannot be whitened.
ZERO_SHARE = 1e-12
BLOCK_ROWS = 1024
_X = f"{OWN}x"


def takes_part(vector: Column) -> Column:
    """Not null, not empty, every entry finite and within ``MAX_ENTRY``."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= MAX_ENTRY))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def integers(vector: Column) -> Column:
    """Every entry c as floor(64 c) + 1,000,000."""
    return F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")) + OFFSET)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in value_slices(batch, BLOCK_ROWS):
            block = _rows(piece.column(0)).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(block)], pa.int64()), pa.array([block.tobytes()], pa.binary())], names=["rows", "block"]
            )


@dataclass(frozen=True)
class Center:
    """n and the sums S of the fitted rows; S / n is split into whole and rest, so that centring rounds once."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[Decimal] | np.ndarray:
        """Exact sum of (n x - S)^2 of every row."""
        most = max((abs(self.n * int(v) - s) for v, s in zip((*x.max(axis=0), *x.min(axis=0)), self.sums * 2)), default=0)
        reach = self.n * int(np.abs(x).max(initial=0))
        if max(most * most * x.shape[1], reach, max(map(abs, self.sums))) < 1 << 62:
            apart = self.n * x - np.array(self.sums, dtype=np.int64)
            return (apart * apart).sum(axis=1)
        return [Decimal(sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums))) for row in x]


def _partial_sums(task: Callable[[np.ndarray], np.ndarray], dimension: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum of ``task(rows)`` over a task's blocks, as (row, values) of the resulting matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("block"):
                part = task(np.frombuffer(block.as_buffer(), dtype="<i8").reshape(-1, dimension))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"]
            )

    return run


class Fitted:
    """The distinct vectors in packed blocks, and passes over them."""

    def __init__(self, blocks: DataFrame, dimension: int, center: Center):
        self.blocks, self.dimension, self.center = blocks, dimension, center

    def _summed(self, task: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        parts = self.blocks.select("block").mapInArrow(_partial_sums(task, self.dimension), "row int, sums array<double>")
        # One value a cell and task; the matrix that comes back is dimension x width.
        cells = parts.select("row", F.posexplode("sums").alias("column", "value")).groupBy("row", "column").agg(F.sum("value").alias("value"))
        out = np.zeros((self.dimension, width))
        for batch in cells.toArrow().to_batches():
            out[batch.column("row").to_numpy(), batch.column("column").to_numpy()] = batch.column("value").to_numpy()
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q, centred before multiplying."""
        center = self.center

        def task(x: np.ndarray) -> np.ndarray:
            rows = center.centred(x)
            return rows.T @ (rows @ q)

        return self._summed(task, q.shape[1]) / center.n

    def variances(self) -> np.ndarray:
        center = self.center
        return self._summed(lambda x: (center.centred(x) ** 2).sum(axis=0)[:, None], 1)[:, 0] / center.n


def fit_rows(vectors: DataFrame, vector_col: str = "embedding") -> Fitted | None:
    """Distinct integer vectors of the most frequent length; None without any."""
    spark = vectors.sparkSession
    usable = vectors.where(takes_part(F.col(vector_col)))
    length = usable.groupBy(F.size(vector_col).alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return None
    d = length["length"]
    distinct = usable.where(F.size(vector_col) == d).select(integers(F.col(vector_col)).alias(_X)).distinct()
    blocks = stored(distinct.mapInArrow(_packed, "rows long, block binary"), "whitening-rows")
    n = blocks.agg(F.sum("rows")).first()[0]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                sums = np.frombuffer(block.as_buffer(), dtype="<i8").reshape(-1, d).astype(object).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(d, dtype=np.int32)), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], names=["row", "s"]
                )

    sums = blocks.select("block").mapInArrow(added, "row int, s decimal(38,0)").groupBy("row").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    by_row = {r["row"]: int(r["s"]) for r in sums.collect()}  # one row a dimension
    return Fitted(blocks, d, Center(n, tuple(by_row[j] for j in range(d))))


@dataclass(frozen=True)
class Whitener:
    """Leading components of the covariance, and how well they whiten the fitted rows."""

    center: Center
    vectors: np.ndarray  # dimension x components, unit columns by falling eigenvalue
    values: np.ndarray
    explained: np.ndarray
    residual: float  # largest residual, relative to the largest eigenvalue
    identity_error: float
    passes: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.center.centred(x) @ self.vectors / np.sqrt(self.values)


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """Degree-``degree`` Chebyshev polynomial of V on [low, cut], scaled to 1 at ``top``, applied to ``q``.

    Within the interval the polynomial stays small, above it it grows; the scaling keeps the
    recurrence from overflowing.
    """
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (times(q) - middle * q) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * following / half * (times(now) - middle * now) - sigma * following * before
        sigma = following
    return now


def fit(fitted: Fitted, components: int = COMPONENTS, degree: int = DEGREE, seed: int = 11) -> Whitener:
    """The ``components`` leading pairs, fewer where the covariance has a smaller rank.

    Raises ``RuntimeError`` if the residuals settle above ``ACCEPTED``.
    """
    d, passes = fitted.dimension, 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return fitted.times(q)

    variances = fitted.variances()
    trace = float(variances.sum())
    scaled = np.random.default_rng(seed).normal(size=(d, min(d, 2 * components)))
    q = np.linalg.qr(scaled)[0]
    best, best_residual, idle = None, np.inf, 0
    for cycle in range(MAX_CYCLES):
        vq = times(q)
        ritz, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        u, vu = q @ turn, vq @ turn
        wanted = min(components, int((ritz > ZERO_SHARE * trace).sum()))
        top = max(float(ritz[0]), 0.0)
        residual = float(np.linalg.norm(vu - u * ritz, axis=0)[:wanted].max(initial=0.0)) / top if top else 0.0
        # Half as small as before counts as progress; twice none is where rounding ends it.
        idle = 0 if residual < best_residual / 2 else idle + 1
        if residual < best_residual:
            best, best_residual = (u[:, :wanted], ritz[:wanted]), residual
        if residual <= CERTIFIED or (idle >= 2 and best_residual <= ACCEPTED):
            break
        if q.shape[1] == d or trace == 0:  # the block spans everything: only rounding is left
            q = np.linalg.qr(u)[0]
            continue
        cut = float(ritz[-1])
        if cut <= ZERO_SHARE * trace:  # the unwanted spectrum is zero: one product suffices
            q = np.linalg.qr(vu)[0]
            continue
        q = np.linalg.qr(chebyshev(times, u, degree, 0.0, cut, top))[0]
    if best_residual > ACCEPTED:
        raise RuntimeError(f"eigenpairs are not certified after {passes} passes: residual {best_residual:.1e}")
    vectors, values = best
    error = 0.0
    if len(values):
        w = vectors / np.sqrt(values)
        error = float(np.abs(w.T @ times(w) - np.eye(len(values))).max())
    return Whitener(fitted.center, vectors, values, values / trace if trace else values, best_residual, error, passes)


_OUT = T.StructType(
    [
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]
)


def _projected(shared) -> Callable[[pa.Array], pa.Array]:
    def run(column: pa.Array) -> pa.Array:
        model: Whitener = shared.value
        out, k = [], len(model.values)
        for first in range(0, len(column), BLOCK_ROWS):
            x = _rows(column.slice(first, BLOCK_ROWS))
            if not len(x):
                continue
            whitened = model.whitened(x)
            deviation = pa.array([Decimal(int(v)) for v in model.center.deviations(x)], pa.decimal128(38, 0))
            fields = {
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(k * len(x), model.center.n, dtype=np.int64)),
                "deviation": deviation.take(pa.array(np.repeat(np.arange(len(x)), k))),
                "whitened": pa.array(whitened.reshape(-1)),
                "explained": pa.array(np.tile(model.explained, len(x))),
                "identity_error": pa.array(np.full(k * len(x), model.identity_error)),
            }
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            out.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields))))
        kind = pa.list_(pa.struct([("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]))
        return pa.concat_arrays([a.cast(kind) for a in out]) if out else pa.array([], kind)

    return run


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, degree: int = DEGREE
) -> DataFrame:
    """One row for every vector that takes part and every component: id, component, n, deviation
    (decimal), whitened, explained, identity_error.

    A vector takes part unless it is null or empty, holds a null, a non-finite entry or one beyond
    2^45, or is not as long as most vectors are. Vectors equal as integers are fitted once but come
    back for every row, repeated and null ids included; other columns are ignored. ``n`` counts the
    fitted vectors, ``deviation`` is the exact sum of (n x - S)^2, ``explained`` the component's share
    of all variance. There are as many components as the covariance has eigenvalues above
    ``ZERO_SHARE`` of its trace, at most ``components``: a table without vectors, or of equal
    vectors only, gives no rows. Between equal eigenvalues the choice of components is free but the
    same for all rows.
    """
    spark = vectors.sparkSession
    fitted = fit_rows(vectors, vector_col)
    named = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None:
        none = spark.createDataFrame([], named)
        return vectors.select(F.col(id_col).alias("id")).limit(0).join(none, F.lit(False))
    shared = spark.sparkContext.broadcast(fit(fitted, components, degree))
    project = F.arrow_udf(_projected(shared), T.ArrayType(_OUT))
    own = vectors.where(takes_part(F.col(vector_col))).where(F.size(vector_col) == fitted.dimension)
    rows = own.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias(_X))
    return rows.select("id", F.explode(project(_X)).alias(_X)).select("id", f"{_X}.*")
