"""What the vector operators share: exact integer vectors, folded sums, distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this (either sign) could overflow a squared distance in 64 bits.
LARGEST = 1 << 27


def sound(vector: str, length: Column | int | None = None) -> Column:
    """Vectors without a null or non-finite component, of that length if one is given."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fits = F.col(vector).isNotNull() & F.forall(vector, number)
    if length is not None:
        fits = fits & (F.size(vector) == length)
    return F.coalesce(fits, F.lit(False))


def integers(vector: str, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double; beyond LARGEST an error."""
    def whole(x: Column) -> Column:
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(value) <= LARGEST, value.cast("int")).otherwise(
            F.raise_error(F.lit("a vector component is too large for exact distances")).cast("int"))
    return F.transform(vector, whole)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of lists of that length as int64 rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of left and right."""
    apart = left - right
    return np.einsum("ij,ij->i", apart, apart)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def folded(
    rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], width: int, kind: str
) -> dict[int, np.ndarray]:
    """Sums of arrays by key. fold makes one array of a partition's rows for each key.

    A partition sends one row per key to the shuffle, and the driver gets one
    row per key, so keys must be bounded by a parameter.
    """
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fold(batches)
        if found:
            sums = np.stack(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), lists(sums, arrow)], ["key", "sums"])

    parts = rows.mapInArrow(run, f"key int, sums array<{kind}>")
    whole = parts.groupBy("key").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    return {row["key"]: np.array(row["sums"], np.int64 if kind == "long" else float) for row in whole.collect()}


def digest_text(values: np.ndarray) -> str:
    """Decimal integers joined by commas."""
    return ",".join(map(str, values.ravel().tolist()))
