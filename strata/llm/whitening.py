"""Whitening of embeddings by principal components.

Entries become integers, x = floor(64 * c) + 1000000, so that sums are exact.
The fit list is each distinct x vector once: copies, however many, count once.

1. Sums S and the covariance V of the fit list (divisor n) are added up by task
   and then by matrix row, centred before multiplying: x - S / n is the exact
   integer n * x - S divided by n. Only V, dimensions squared, reaches the driver.
2. V is decomposed in float32. The vectors are then corrected by the
   matrix-multiplication iterations of Ogita and Aishima in extended precision
   (``refined``), each of which about squares the error: with R = I - X'X and
   S = X'VX, X becomes X + XE, E_ij = (S_ij + l_j R_ij) / (l_j - l_i). Pairs of
   eigenvalues closer than the error bound are a cluster; it only becomes
   orthogonal, E_ij = R_ij / 2, and its own small problem, shifted by its mean,
   is solved and applied before the next iteration.
3. Every row is projected. The whitened covariance of the fit list is measured
   by the same distributed sums.

Defined results: rows whose vector is null or holds null or non-finite entries
are left out; entries over 2 ** 53 / 64 count as that (either sign); a vector
shorter than the longest is filled up with zero entries; directions without
variance (eigenvalue 0 within rounding) are no components, so fewer than two
distinct vectors, or an empty table, give no rows; a deviation beyond a long is
null; repeated rows come out each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize

#: Fixed values of the contract: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
MOST = float(1 << 53)
COMPONENTS = 16
#: Up to this many dimensions the iterations run in extended precision, beyond in float64.
EXTENDED = 512
ITERATIONS = 12


def fixed_point(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the usable rows with their integer vectors."""
    v = F.col(vec_col)
    # a null entry makes the comparison null, NaN and the infinities fail it
    usable = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(v, lambda c: (F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST)))
                                       + OFFSET).cast("long"))
    return rows.filter(usable).select(F.col(id_col).alias("vec_id"), scaled.alias("x"))


def filled(rows: DataFrame, size: int) -> DataFrame:
    missing = F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(size) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < size, F.concat("x", missing)).otherwise(F.col("x")))


def matrices(batches, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def exact_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension, exactly."""

    def run(batches):
        n, total = 0, np.zeros(size, object)
        for _, x in matrices(batches, size):
            n += len(x)
            for part in np.array_split(x, -(-len(x) // 512)):  # 512 * 2**53 fits a long
                total += part.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()),
                                          pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "v"])

    got = dict(map(tuple, rows.select("x").mapInArrow(run, "i int, v decimal(38,0)")
                   .groupBy("i").agg(F.sum("v")).collect()))
    return int(got.get(-1, 0)), [int(got.get(i, 0)) for i in range(size)]


def summed(rows: DataFrame, size: int, shape: tuple[int, int], term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``term`` (a matrix of ``shape``) over all blocks of x rows: by
    task, then by matrix row in the order of the tasks, so runs agree."""
    height, width = shape

    def partial(batches):
        total = np.zeros(shape)
        for _, x in matrices(batches, size):
            total += term(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(height, dtype=np.int32)), pa.array([TaskContext.get().partitionId()] * height, pa.int32()),
             pa.array(list(total), pa.list_(pa.float64()))], ["i", "part", "row"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for i, row in zip(batch.column("i").to_pylist(), values):
                total[i] = total.get(i, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])

    out = np.zeros(shape)
    for i, row in rows.select("x").mapInArrow(partial, "i int, part int, row array<double>") \
            .repartition("i").sortWithinPartitions("i", "part").mapInArrow(add, "i int, row array<double>").collect():
        out[i] = row
    return out


def exact_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as long integers where they fit, else as Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (exact_offsets(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    off = exact_offsets(x, n, sums)
    most = int(np.abs(off).max(initial=0))
    if most * most * off.shape[1] >= 1 << 63:
        off = off.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def clusters(values: np.ndarray, within: float) -> list[np.ndarray]:
    """Index sets of neighbouring values no further apart than ``within``."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > within) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``v`` from approximate vectors ``x``."""
    kind = np.longdouble if len(v) <= EXTENDED else np.float64
    a, x, one = v.astype(kind), x.astype(kind), np.eye(len(v), dtype=kind)
    size, exact = np.sqrt((a * a).sum()), 2.0 ** -53
    for _ in range(ITERATIONS):
        r, s = symmetric(one - x.T @ x), symmetric(x.T @ (a @ x))  # so that E + E' is exactly R
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for c in clusters(values, bound):
            mean = values[c].mean()
            # shifted: what tells the members apart is not lost
            inner = symmetric(x[:, c].T @ (a @ x[:, c] - mean * x[:, c]))
            scale = np.abs(inner).max() or 1
            x[:, c] = x[:, c] @ np.linalg.eigh((inner / scale).astype(np.float64))[1].astype(kind)
        if np.abs(e).max() <= exact:
            break
    for _ in range(2):  # what the sub-solves' float64 left
        x = x + x @ (symmetric(one - x.T @ x) / 2)
    return np.diag(x.T @ (a @ x)), x


def decomposed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and their unit vectors as columns; the
    entry of a vector that is largest in size is positive."""
    scale = 2.0 ** np.floor(np.log2(np.abs(v).max(initial=0) or 1))  # exact, keeps float32 in range
    values, x = refined(v / scale, np.linalg.eigh((v / scale).astype(np.float32))[1])
    order = np.argsort(-values, kind="stable")
    values, x = values[order].astype(np.float64), x[:, order].astype(np.float64)
    used = values > (values[0] if len(values) else 0) * len(v) * 2.0 ** -46
    values, x = values[used] * scale, x[:, used]
    x = x / np.sqrt((x * x).sum(axis=0))
    return values, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What a fit knows; all of it is bounded by the dimensions squared."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def fit(distinct: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Fit to a table of distinct integer vectors ``x`` of one size."""
    n, sums = exact_sums(distinct, size)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((size, 0)), 0.0)

    def product(x):
        z = centred(x, n, sums)
        return z.T @ z

    v = summed(distinct, size, (size, size), product) / n
    values, vectors = decomposed(symmetric(v))
    return Whitening(n, sums, values[:components], vectors[:, :components], float(np.trace(v)))


def identity_error(distinct: DataFrame, size: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance of the fit list less the identity."""
    k = len(model.values)
    mean = summed(distinct, size, (1, k), lambda x: model.apply(x).sum(axis=0, keepdims=True))[0] / model.n

    def product(x):
        w = model.apply(x) - mean
        return w.T @ w

    return float(np.abs(summed(distinct, size, (k, k), product) / model.n - np.eye(k)).max())


def whitening(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
              components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    points = fixed_point(rows, id_col, vec_col)
    schema = f"vec_id {points.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, " \
        "whitened double, explained double, identity_error double"
    size = points.agg(F.max(F.size("x"))).first()[0] or 0
    points = filled(points, size)
    distinct = materialize(points.select("x").distinct(), "vectors") if size else None
    model = fit(distinct, size, components) if size else None
    k = len(model.values) if model else 0
    if not k:
        return points.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, size, model)
    explained = model.values / model.trace

    def run(batches):
        for batch, x in matrices(batches, size):
            many = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                pa.array(np.full(many * k, model.n, np.int64)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                pa.array(model.apply(x).reshape(-1)), pa.array(np.tile(explained, many)),
                pa.array(np.full(many * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return points.mapInArrow(run, schema)
