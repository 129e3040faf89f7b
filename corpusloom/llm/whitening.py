"""Whitening of embeddings: streaming covariance, merged across partitions, and a symmetric QR eigen-solve.

Each task passes over its vectors once and updates count, mean and co-moments by one rank-one term a vector (Welford). States of
partitions are merged by the parallel update formula, level by level, so what meets in one place is a few states, however many
partitions there are. The covariance matrix, whose size depends on the number of dimensions alone, is reduced to three diagonals by
reflections and solved by implicit QR steps on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches

#: An entry c counts as the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: States of partitions are merged into so many, then so many, then one.
LEVELS = (64, 8)
STATE = "n bigint, mean binary, moments binary, sums binary"


class Moments:
    """Count, mean, sum of centred products, and exact sums of whole vectors."""

    def __init__(self, d: int):
        self.n, self.mean, self.products, self.sums = 0, np.zeros(d), np.zeros((d, d)), np.zeros(d, np.int64)

    def add(self, rows: np.ndarray, whole: bool) -> None:
        """One rank-one update a row."""
        n, mean, products, term = self.n, self.mean, self.products, np.empty_like(self.products)
        for x in rows:
            n += 1
            delta = x - mean
            mean += delta / n
            np.multiply.outer(delta, x - mean, out=term)
            products += term
        self.n = n
        if whole:
            self.sums += rows.astype(np.int64).sum(axis=0)

    def merge(self, other: Moments) -> None:
        """The parallel update: products of both, and a rank-one term of the difference of means."""
        if len(self.mean) != len(other.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(other.mean)} entries")
        n = self.n + other.n
        delta = other.mean - self.mean
        self.products += other.products + np.multiply.outer(delta, delta) * (self.n * other.n / n)
        self.mean += delta * (other.n / n)
        self.sums += other.sums
        self.n = n

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (self.mean, self.products, self.sums))], names=["n", "mean", "moments", "sums"])

    @classmethod
    def read(cls, n: int, mean: bytes, products: bytes, sums: bytes) -> Moments:
        out = cls(0)
        out.n, out.mean, out.sums = n, np.frombuffer(mean).copy(), np.frombuffer(sums, np.int64).copy()
        out.products = np.frombuffer(products).reshape(len(out.mean), -1).copy()
        return out


def merged(states: Iterable[Moments]) -> Moments | None:
    out = None
    for s in states:
        if out is None:
            out = s
        else:
            out.merge(s)
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and orthogonal q with a = q t q', by reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest down and unit eigenvectors (columns) of a symmetric matrix: implicit QR steps with Wilkinson's shift."""
    d = len(a)
    diag, sub, q = tridiagonal(np.asarray(a, float))
    q = np.ascontiguousarray(q.T)  # rows are turned
    eps = np.finfo(float).eps
    last, left = d - 1, steps * max(d, 1)
    while last > 0:
        sub[np.abs(sub) <= eps * (np.abs(diag[:-1]) + np.abs(diag[1:]))] = 0
        if sub[last - 1] == 0:
            last -= 1
            continue
        left -= 1
        if left < 0:
            raise ArithmeticError("the eigen-solve does not settle")
        first = last - 1
        while first > 0 and sub[first - 1] != 0:
            first -= 1
        half = (diag[last - 1] - diag[last]) / 2
        e = sub[last - 1]
        shift = diag[last] - e * e / (half + np.copysign(np.hypot(half, e), half))
        x, z = diag[first] - shift, sub[first]
        for k in range(first, last):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                sub[k - 1] = r
            p, t, o = diag[k], diag[k + 1], sub[k]
            diag[k], diag[k + 1] = c * c * p + 2 * c * s * o + s * s * t, s * s * p - 2 * c * s * o + c * c * t
            sub[k] = c * s * (t - p) + (c * c - s * s) * o
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
            if k < last - 1:
                x, z = sub[k], s * sub[k + 1]
                sub[k + 1] *= c
    order = np.argsort(-diag, kind="stable")
    return diag[order], q[order].T


@dataclass(frozen=True)
class Whitening:
    """What a fit gives; as large as the number of dimensions squared, whatever the number of rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components along which the vectors differ at all; the others have no whitened value."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values[0], 0) if len(self.values) else np.zeros(0, bool)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact; Python's integers where 64 bits might not do."""
        if int(np.abs(x).max()) * self.n < 1 << 62:
            return x.astype(np.int64) * self.n - self.sums
        return x.astype(np.int64).astype(object) * self.n - self.sums.astype(object)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        scale = np.where(self.usable[:k], np.sqrt(np.maximum(self.values[:k], np.finfo(float).tiny)), np.nan)
        return (self.deviations(x) / self.n).astype(float) @ self.vectors[:, :k] / scale


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are not null, not empty and all finite, and those as whole numbers less OFFSET, which moves no covariance."""
    starts = np.asarray(column.offsets)
    flat = column.values.slice(starts[0], starts[-1] - starts[0]).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = starts - starts[0]
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    sizes = np.diff(starts)
    good = np.flatnonzero(np.asarray(column.is_valid()) & (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]]))
    if not len(good):
        return good, np.zeros((0, 0))
    d = sizes[good[0]]
    if (sizes[good] != d).any():
        raise ValueError(f"vectors of {d} and of {sizes[good][sizes[good] != d][0]} entries")
    rows = np.floor(SCALE * flat[starts[good][:, None] + np.arange(d)])
    if np.abs(rows).max() >= 1 << 52:
        raise OverflowError("an entry is too large to be counted exactly")
    return good, rows


def moments(df: DataFrame, column: str, model: Whitening | None = None, components: int = COMPONENTS) -> Moments | None:
    """Moments of the usable vectors of df, or of what the model makes of them; None without any."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            good, rows = whole(batch.column(0))
            if len(good):
                if model is not None:
                    rows = model.whitened(rows + OFFSET, components)[:, model.usable[:components]]
                if state is None:
                    state = Moments(rows.shape[1])
                elif rows.shape[1] != len(state.mean):
                    raise ValueError(f"vectors of {len(state.mean)} and of {rows.shape[1]} entries")
                state.add(rows, model is None)
        if state is not None:
            yield state.row()

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = merged(Moments.read(*(c[i].as_py() for c in batch.columns)) for batch in batches for i in range(batch.num_rows))
        if state is not None:
            yield state.row()

    states = df.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(first, STATE)
    for parts in LEVELS:
        states = states.repartition(parts).mapInArrow(then, STATE)
    return merged(Moments.read(r["n"], r["mean"], r["moments"], r["sums"]) for r in states.collect())  # LEVELS[-1] rows


def fit(df: DataFrame, column: str = "embedding") -> Whitening | None:
    """Mean and principal axes of the usable vectors; None if there are none."""
    found = moments(df, column)
    if found is None:
        return None
    covariance = found.products / found.n
    values, vectors = symmetric_qr((covariance + covariance.T) / 2)
    return Whitening(found.n, found.sums + found.n * OFFSET, values, vectors, float(np.trace(covariance)))


def whiten(df: DataFrame, model: Whitening | None, components: int = COMPONENTS, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double).

    One row for each usable vector and each of the first components, numbered from 1. Vectors that are null or empty or hold null,
    NaN or infinite entries are left out; without any usable one the result is empty. Along components that do not vary (a single
    vector, equal vectors, constant or dependent dimensions) whitened is null; explained is null if nothing varies at all.
    identity_error is over the components that vary, 0 without any. Ids may be null or repeat; equal rows give equal rows; other
    columns are not read, whatever their names. Vectors of different lengths, and entries of 2 ** 46 and more, are an error.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    k = min(components, len(model.values))
    error = 0.0
    if model.usable[:k].any():
        second = moments(df, column, model, components)
        error = float(np.abs(second.products / second.n - np.eye(len(second.mean))).max())
    shared = spark.sparkContext.broadcast(model)  # dimensions squared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            good, rows = whole(batch.column(1))
            if not len(good):
                continue
            x = rows + OFFSET
            far = model.deviations(x)
            if int(np.abs(far).max()) ** 2 * far.shape[1] < 1 << 63:
                deviation = pa.array((far * far).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(sum(v * v for v in r)) for r in far.tolist()], pa.decimal128(38, 0))
            white = model.whitened(x, components)
            values = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * k), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), deviation, lists], names=["vec_id", "deviation", "white"])

    rows = df.select(F.col(id_col).alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, f"vec_id {id_type}, deviation decimal(38,0), white array<double>")
    explained = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values[:k]])
    out = rows.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit(vectors)).withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
