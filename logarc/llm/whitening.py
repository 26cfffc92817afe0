"""PCA whitening of embeddings: exact integer sums, a covariance of centred vectors, components by spectrum slicing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spectrum import leading_eigenpairs

# Steps of the fixed grid in one unit, and the offset that keeps usual values positive (fixed values).
GRID = 64
OFFSET = 1_000_000
COMPONENTS = 32
# Largest dimension of which the square comes to the driver, 8 bytes each.
MAX_DIMENSION = 2048
# Rows worked on at a time inside a task.
_ROWS = 2048
_LONG = 1 << 63


@dataclass
class Whitener:
    """What whitening needs to know of the fit list."""

    n: int
    sums: np.ndarray  # of each dimension
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # unit columns
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x) / self.n

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        if len(x) and float(np.abs(x).max()) * self.n * 2 >= _LONG:
            raise OverflowError("an entry times the number of rows is beyond 64 bits")
        return x * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def grid_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without a null or non-finite entry, where their entries begin, and all grid values of the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    fine = np.isfinite(flat)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    whole = (bad[begin + size] == bad[begin]) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    scaled = np.floor(np.where(fine, flat, 0.0) * GRID)
    if len(scaled) and float(np.abs(scaled).max()) >= 2.0**62:
        raise OverflowError("an entry is beyond the 64-bit grid")
    return np.flatnonzero(whole), np.column_stack([begin, size]), scaled.astype(np.int64) + OFFSET


def _rows_of(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the rows that are kept, and their grid vectors."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            rows, place, x = grid_vectors(batch.column("vector"))
            rows = rows[place[rows, 1] == dimension]
            yield batch, rows, x[place[rows, 0][:, None] + np.arange(dimension)]


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Learns from all rows of the table; None if no row has a vector.

    A pass sums the grid values, exactly; a second one sums the products of centred vectors. Every
    task returns one matrix, and these are added up by its rows. Only the sums reach the driver.
    Vectors of another length than most are left out like those with null or non-finite
    entries (of lengths equally frequent the larger stays).
    """
    rows = vectors.select(vectors[vector].alias("vector"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                kept, place, x = grid_vectors(batch.column("vector").slice(at, _ROWS))
                for size in np.unique(place[kept, 1]).tolist():
                    own = place[kept, 0][place[kept, 1] == size]
                    part = x[own[:, None] + np.arange(size)].sum(axis=0)
                    sums[size] = sums.get(size, 0) + np.append(part, len(own))
        for size, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size + 1, size)), pa.array(np.append(np.arange(size), -1)), pa.array(total)], ["size", "at", "total"]
            )

    summed = rows.mapInArrow(add, "size long, at long, total long").groupBy("size", "at").agg(F.sum("total").alias("total"))
    summed = stored(summed, "vector-sums")
    most = summed.filter("at = -1").orderBy(F.desc("total"), F.desc("size")).first()
    if most is None or most["size"] == 0:
        return None
    if most["size"] > MAX_DIMENSION:
        raise ValueError(f"vectors of {most['size']} entries; the limit is {MAX_DIMENSION}")
    sums = np.zeros(most["size"], np.int64)
    for row in summed.filter(F.col("size") == most["size"]).filter("at >= 0").collect():
        sums[row["at"]] = row["total"]
    n = int(most["total"])
    model = Whitener(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    covariance = _products(rows, model.centred, len(sums), len(sums)) / n
    values, columns = leading_eigenpairs(covariance, components)
    return Whitener(n, sums, values, columns, float(np.trace(covariance)))


def _products(rows: DataFrame, centred: Callable[[np.ndarray], np.ndarray], dimension: int, width: int) -> np.ndarray:
    """Sum over all kept rows of the products of their centred entries, ``width`` by ``width``."""
    i, j = np.triu_indices(width)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, _, x in _rows_of(batches, dimension):
            z = centred(x)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(i * width + j), pa.array(total[i, j])], ["at", "total"])

    table = rows.mapInArrow(multiply, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(width * width)
    out[table.column("at").to_numpy()] = table.column("total").to_numpy()
    upper = out.reshape(width, width)
    return upper + np.triu(upper, 1).T


def _means(rows: DataFrame, model: Whitener) -> np.ndarray:
    """Means of the whitened columns over the fit list."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.values))
        for _, _, x in _rows_of(batches, model.dimension):
            total += model.whitened(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "total"])

    out = np.zeros(len(model.values))
    for row in rows.mapInArrow(add, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        out[row["at"]] = row["total"]
    return out / model.n


def identity_error(vectors: DataFrame, model: Whitener, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over the fit list."""
    width = len(model.values)
    if not width:
        return 0.0
    rows = vectors.select(vectors[vector].alias("vector"))
    means = _means(rows, model)
    covariance = _products(rows, lambda x: model.whitened(x) - means, model.dimension, width) / model.n
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(vectors: DataFrame, model: Whitener | None, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, deviation, whitened`` of every row whose vector the model can take; other rows go.

    ``deviation`` is the exact sum over dimensions of ``(n * x - sums) ** 2``; ``whitened`` holds a
    double for each component. Null ids and repeated rows stay. Vectors that are null, hold null
    or non-finite entries or have another length than the model's are dropped; an empty
    vector too. Without a model (an empty table) there are no rows. Entries beyond the
    64-bit grid stop the job rather than wrap. Other columns are ignored, whatever their names.
    """
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.limit(0).selectExpr("vec_id", "CAST(0 AS DECIMAL(38,0)) AS deviation", "CAST(array() AS ARRAY<DOUBLE>) AS whitened")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, kept, x in _rows_of(batches, model.dimension):
            white = model.whitened(x)
            first = np.arange(len(kept) + 1, dtype=np.int32) * white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(first), pa.array(white.reshape(-1)))
            ids = batch.column("vec_id").take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([ids, _squares(model.offsets(x)), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(project, schema)


def _squares(y: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact however large."""
    kind = pa.decimal128(38, 0)
    if not y.size or float(np.abs(y).max()) ** 2 * y.shape[1] < _LONG / 2:
        return pa.array((y * y).sum(axis=1)).cast(kind)
    return pa.array([Decimal(sum(int(v) * int(v) for v in row)) for row in y], kind)


def whitened_rows(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Fits, measures and whitens: a row for each kept vector and component, from 1 by falling eigenvalue.

    ``vec_id, component, n, deviation, whitened, explained, identity_error``; nulls, lengths, ties,
    repeated rows and empty tables as in ``fit_whitening`` and ``whiten``. Components whose
    eigenvalue is zero but for rounding (fewer different vectors than dimensions, constant
    dimensions) have no whitened value and are left out. ``deviation`` is null only where
    the exact sum is beyond 64 bits; ``whiten`` has it as a decimal.
    """
    model = fit_whitening(vectors, vector, components)
    error = 0.0 if model is None else identity_error(vectors, model, vector)
    shares = [] if model is None else (model.values / model.trace).tolist()
    white = whiten(vectors, model, vector, vec_id)
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(0 if model is None else model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
