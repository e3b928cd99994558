"""Whitened embeddings on their leading principal directions, found by spectrum slicing.

Components become whole numbers first, so counts, sums and deviations from the mean are
exact however the rows are dealt out; a task adds up its rows, and the driver sees sums
over all rows only: one number per dimension, and one matrix of dimension by dimension.
Its leading eigenvectors come from ``spectrum.leading``: counts of eigenvalues above a
shift isolate each, Rayleigh quotients converge to it, and counts certify its number.

Rows whose vector is null or holds null, NaN or infinite components are dropped, as are
those with a component of 2^42 or more, which a double can't hold in 1024ths, and those
whose length is not the most frequent one (of equally frequent ones the largest counts).
No remaining row, equal vectors only, or empty vectors give no component and so no rows;
directions without spread are left out. A deviation beyond a long is null. Rows may
repeat and a vec_id may be null.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwatch.llm.common import narrowed, table
from shelfwatch.llm.spectrum import leading
from shelfwatch.llm.vectors import common_dimension, is_finite, matrix, slices, summed

# Fixed values of the contract: steps of a component, and what is added to it.
STEPS = 1024
OFFSET = 100_000
COMPONENTS = 8

LARGEST = 2**42
LONG = 2**63


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as whole numbers."""
    return np.floor(STEPS * matrix(batch.column("vector"))).astype(np.int64) + OFFSET


def usable_rows(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and their number of components."""
    rows = narrowed(embeddings, "vec_id", "embedding").withColumnRenamed("embedding", "vector")
    held = is_finite(F.col("vector")) & ~F.exists("vector", lambda x: F.abs(x) >= F.lit(float(LARGEST)))
    rows = rows.filter(F.coalesce(held, F.lit(False)))
    dimension = common_dimension(rows, "vector")
    return rows.filter(F.size("vector") == dimension), dimension


@dataclass
class Centre:
    """Number of vectors and sum per dimension, exact."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs, or Python's integers where longs may not do."""
        small = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < LONG
        kind = np.int64 if small else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum of squared deviations of each row, None beyond a long."""
        d = self.deviations(x)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= LONG / 2:
            d = d.astype(object)
        return [int(s) if s < LONG else None for s in (d * d).sum(axis=1)]


def centre_of(rows: DataFrame, dimension: int) -> Centre:
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for batch in slices(batches):
            n += batch.num_rows
            sums = [a + int(b) for a, b in zip(sums, whole(batch).sum(axis=0))]
        if n:
            total = pa.array([n, *sums], type=pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dimension + 1)), total], names=["i", "total"])

    totals = rows.mapInArrow(of_task, "i long, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total"))
    n, *sums = [int(r.total) for r in totals.orderBy("i").collect()] or [0]
    return Centre(n, sums)


@dataclass
class Whitening:
    centre: Centre
    directions: np.ndarray  # columns, divided by the root of their eigenvalue
    explained: list[float]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions


def fit(rows: DataFrame, dimension: int, count: int = COMPONENTS) -> Whitening:
    """The whitening of all ``rows``; it has no direction where there is no spread."""
    centre = centre_of(rows, dimension)

    def scatter(batch: pa.RecordBatch) -> np.ndarray:
        c = centre.centred(whole(batch))
        return c.T @ c

    covariance = summed(rows, scatter, (dimension, dimension)) / max(centre.n, 1)
    found = leading(covariance, count)
    scaled = [vector / np.sqrt(value) for value, vector in found]
    explained = [value / float(np.trace(covariance)) for value, _ in found]
    return Whitening(centre, np.array(scaled).reshape(-1, dimension).T, explained)


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """The largest entry of the covariance of all whitened rows less the identity."""
    k, n = len(fitted.explained), fitted.centre.n

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = np.column_stack([fitted.whitened(whole(batch)), np.ones(batch.num_rows)])
        return w.T @ w

    total = summed(rows, moments, (k + 1, k + 1)) / n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, with what the contract of op13 lists."""
    kind = dict(embeddings.dtypes)["vec_id"]
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows, dimension = usable_rows(embeddings)
    fitted = fit(rows, dimension, count) if dimension else None
    if fitted is None or not fitted.explained:
        return embeddings.sparkSession.createDataFrame([], schema)
    k, error = len(fitted.explained), identity_error(rows, fitted)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, m = whole(batch), batch.num_rows
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            squares = pa.array(fitted.centre.squares(x), type=pa.int64())
            columns = {
                "vec_id": ids,
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, fitted.centre.n, dtype=np.int64)),
                "deviation": squares.take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": pa.array(fitted.whitened(x).ravel()),
                "explained": pa.array(np.tile(fitted.explained, m)),
                "identity_error": pa.array(np.full(m * k, error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(written, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
