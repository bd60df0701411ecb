"""Whitening of embeddings: principal directions by a distributed singular value decomposition, rows scaled to unit variance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import cut, table
from wayline.llm.sums import task_sum, total

#: Steps a unit is cut into, what is added so that numbers stay positive, components returned.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Singular values below this share of the largest (eigenvalues below its square) are rounding, not directions.
RANK = 1e-6


@dataclass(frozen=True)
class Whitening:
    """n vectors with the sums `sums`: unit components (a row each) with their eigenvalues, falling; the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S as exact longs, for rows x."""
        return self.n * x - np.array(self.sums, np.int64)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def whole_numbers(vector: Column) -> Column:
    """floor(64*c)+1000000 of each entry c, as longs."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * STEPS).cast("long") + SHIFT)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector is neither null nor empty nor holds null or non-finite entries; where lengths
    differ, of those with the commonest length (of two, the shorter)."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("_v")).where(
        F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", _finite)
    )
    lengths = rows.groupBy(F.size("_v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.size("_v") == (lengths["length"] if lengths else 0)).select("vec_id", whole_numbers(F.col("_v")).alias("x"))


def _batches(rows: DataFrame, made: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what `made` gives for a batch of their x (a vector of `size`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                here += made(matrix(batch))
        yield task_sum(here)

    return total(rows.select("x").mapInArrow(run, "vector binary"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """distinct: x, each vector once. None if nothing varies.

    The covariance's eigenvectors are the right singular vectors of the centred rows, and its eigenvalues the squared
    singular values over n. All of them are asked for, not the first few: the decomposition then takes the whole Gramian
    through LAPACK, which is exact to double precision where neighbouring eigenvalues nearly tie; an iterative solver
    stops earlier. Rows stay in Spark; the driver gets the Gramian, whose size is the vectors' length squared. The trace
    comes from the exact deviations instead.
    """
    sums_of = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    found = sorted(sums_of.collect(), key=lambda r: r["i"])  # one row a dimension
    if not found:
        return None
    n, sums = found[0]["n"], [r["s"] for r in found]
    apart = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda a, s: F.lit(n).cast("long") * a - s)
    rows = distinct.select(apart.alias("d"))
    squares = F.aggregate("d", F.lit(0).cast("long"), lambda t, d: t + d * d)
    spread = rows.agg(F.sum(squares.cast("decimal(38,0)"))).first()[0]
    if not spread:
        return None
    centred = rows.select(array_to_vector(F.transform("d", lambda d: d.cast("double") / n)).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v")).computeSVD(len(sums), rCond=RANK)
    values, directions = found.s.toArray(), found.V.toArray().T
    kept = min(components, len(values))
    return Whitening(n, sums, directions[:kept], values[:kept] ** 2 / n, float(int(spread) / n**3))


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n, centred first) minus the identity."""
    k = len(w.eigenvalues)
    mean = _batches(distinct, lambda x: w.whiten(w.deviations(x)).sum(0), k) / w.n

    def products(x: np.ndarray) -> np.ndarray:
        c = w.whiten(w.deviations(x)) - mean
        return (c.T @ c).ravel()

    return float(np.abs(_batches(distinct, products, k * k).reshape(k, k) / w.n - np.eye(k)).max())


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per valid vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    vectors: vec_id, embedding. Rows are valid as `valid_rows` says: null and empty vectors, and those with null, NaN or
    infinite entries, have none. Each distinct vector counts once in the fit; repeated rows and ids are whitened each.
    There are at most `components` components, no more than dimensions, and none along which the eigenvalue is under
    RANK^2 of the largest: nothing can be scaled to unit variance there. A table whose vectors are all equal, or that has
    none, gives no rows. Entries must be below 2^40 in absolute value, and a deviation must fit a long, else it fails:
    a result that is not exact is never given. Components that tie in their eigenvalue come in any order. Other columns
    are ignored.
    """
    rows = valid_rows(vectors)
    distinct = cut(rows.select("x").distinct())
    w = fit(distinct, components)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return vectors.sparkSession.createDataFrame([], kind)
    error, explained, k = identity_error(distinct, w), w.eigenvalues / w.trace, len(w.eigenvalues)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            d = w.deviations(matrix(batch))
            if (d.astype(float) ** 2).sum(1).max() >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a deviation does not fit a long")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n)), pa.array(np.repeat((d * d).sum(1), k)), pa.array(w.whiten(d).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(scored, kind)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"))
