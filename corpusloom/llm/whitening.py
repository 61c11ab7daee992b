"""Whitening of embeddings by two passes over their distinct vectors.

Entries become integers, so that the first pass gives the number of vectors and each dimension's sum without error. The
second pass centres every vector (n * x - S is an integer; its quotient by n is rounded once) and sums outer products by
matrix products in NumPy. Tasks give one partial matrix each; treeAggregate merges these in steps, so that the driver
gets a handful whatever the number of tasks. LAPACK's symmetric solver makes the components on the driver, which
a third pass checks (covariance of the whitened vectors) and which are sent to all tasks to project every row. Only
distinct vectors are shuffled, once, to find them; copies merge before that, so a vector that a third of all rows hold costs
no more than another. The distinct vectors are written to the shared folder, and a lost executor costs a read.

A matrix has the square of the dimension's entries (64: 32 KB); a task and the driver hold a few of them.

Defined edge cases: rows whose vector is null, or holds null or non-finite entries, take no part and are not returned;
an empty vector counts as one of zeros. Vectors shorter than the longest one count as followed by zeros. Repeated rows
and vectors are projected row by row, but count once in the fit. A component without variance (its eigenvalue is
not beyond rounding) has a null whitened value and share 0, or a null share where nothing varies; identity_error then
covers the others, and is null where there are none. Rows without a vec_id are projected like others. An empty table
gives no rows. Extra columns are ignored. deviation is a decimal of 38 digits; the query casts it to long and gives null
where it is larger (from some millions of vectors on).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Vectors whose products a task sums at a time.
STEP = 8192


def finite(vector: str):
    """True of vectors without null or non-finite entries; null of null vectors."""
    bound = F.lit(float("inf"))
    return ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == bound))


def scaled(rows: DataFrame, vector: str, scale: int, shift: int, width: int):
    """The column of floor(scale * entry) + shift, filled up to width as if zeros followed."""
    x = F.transform(vector, lambda c: F.floor(scale * c.cast("double")) + shift)
    return F.concat(x, F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size(x)))


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def summed(df: DataFrame, part, empty: list[np.ndarray]) -> list[np.ndarray]:
    """Sums over all rows: part gives the arrays of a matrix of rows (from df's only column), of the shapes and types of
    empty. Each task gives one row, and treeAggregate merges them."""
    kinds = [(a.shape, a.dtype.str) for a in empty]

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            rows = matrix(batch.column(0)) if batch.num_rows else ()
            for at in range(0, len(rows), STEP):
                new = part(rows[at : at + STEP])
                total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(np.ascontiguousarray(a).astype(k).tobytes() for a, (_, k) in zip(total, kinds, strict=True))], pa.binary())], names=["sums"])

    def read(sums: bytes) -> list[np.ndarray]:
        out, at = [], 0
        for shape, kind in kinds:
            n = int(np.prod(shape, dtype=np.int64))
            out.append(np.frombuffer(sums, kind, n, at).reshape(shape))
            at += n * np.dtype(kind).itemsize
        return out

    def add(total: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
        return [a + b for a, b in zip(total, new, strict=True)]

    return df.mapInArrow(run, "sums binary").rdd.treeAggregate(empty, lambda total, row: add(total, read(bytes(row.sums))), add)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean: (n * x - sums) / n, rounded once."""
    return (n * x - sums) / n


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    vectors: np.ndarray  #: Components as columns, by falling eigenvalue.
    values: np.ndarray  #: Their eigenvalues; 0 where they are not beyond rounding.
    explained: np.ndarray
    identity_error: float | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values), np.nan)


def covariance(fit: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, covariance) of the vectors (the only column of fit, integers). Limbs of 31 bits keep the sums exact
    beyond 2**63."""

    def first(x):
        return [np.array([len(x)]), (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)]

    count, high, low = summed(fit, first, [np.zeros(1, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)])
    n = int(count[0])
    sums = np.array([(int(h) << 31) + int(s) for h, s in zip(high, low, strict=True)], object)
    if n and max(abs(int(s)) for s in sums) < 2**62:
        sums = sums.astype(np.int64)

    def second(x):
        y = np.asarray(centred(x, n, sums), np.float64)
        return [y.T @ y]

    (outer,) = summed(fit, second, [np.zeros((width, width))])
    return n, sums, outer / max(n, 1)


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors fit (its only column); None where there are none."""
    n, sums, v = covariance(fit, width)
    if not n:
        return None
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(v))
    some = values[order] > 8 * width * np.finfo(float).eps * max(float(values[-1]), 0.0)
    kept = np.where(some, values[order], 0.0)
    model = Whitening(n, sums, np.ascontiguousarray(vectors[:, order]), kept, kept / trace if trace > 0 else np.full(len(order), np.nan))
    used = np.flatnonzero(some)
    if len(used):

        def third(x):
            w = np.asarray(model.apply(x)[:, used], np.float64)
            return [w.sum(0), w.T @ w]

        mean, outer = summed(fit, third, [np.zeros(len(used)), np.zeros((len(used), len(used)))])
        model.identity_error = float(np.abs(outer / n - np.outer(mean / n, mean / n) - np.eye(len(used))).max())
    return model


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each row of rows (vec_id, embedding) with a finite vector and each component (from 1, by falling variance)."""
    good = rows.select(F.col("vec_id").cast("long"), "embedding").where(F.coalesce(finite("embedding"), F.lit(False)))
    width = good.agg(F.max(F.size("embedding"))).first()[0] or 0
    spark = rows.sparkSession
    empty = spark.createDataFrame([], WHITENED)
    if not width:
        return empty
    whole = good.select("vec_id", scaled(good, "embedding", scale, shift, width).alias("x"))
    model = fit_whitening(written(whole.select("x").distinct(), "vectors"), width, components)
    if model is None:
        return empty
    held, m = spark.sparkContext.broadcast(model), len(model.values)

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                x = matrix(some.column("x"))
                apart = model.n * x - model.sums
                if int(np.abs(apart).max()) ** 2 * width >= 2**63:
                    apart = apart.astype(object)
                deviation = pa.array([Decimal(int(d)) for d in (apart * apart).sum(1)], pa.decimal128(38, 0))
                k = len(x)
                columns = [
                    some.column("vec_id").take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * m, model.n)),
                    deviation.take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(np.asarray(model.apply(x), np.float64).ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, k), from_pandas=True),
                    pa.array([model.identity_error] * (k * m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in WHITENED.split(", ")])

    return whole.mapInArrow(run, WHITENED)


def op11_two_pass_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
