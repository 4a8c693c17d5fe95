"""Integer vectors for the operators on embeddings: cleaned, floored, packed into binary columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import map_batches

#: Embedding components are counted in steps of one over this.
SCALE = 256.0


def usable(vector: str) -> Column:
    """The vector is there, and every component of it is a finite number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def floored(vector: str) -> Column:
    """Components as whole steps: ``floor(256 * c)`` as long; beyond that type, its nearest value."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(SCALE)))


@dataclass(frozen=True)
class Shape:
    """What a table of integer vectors holds: rows, longest vector, extreme components, largest squared length."""

    rows: int
    dim: int
    low: int
    high: int
    squared: float

    @property
    def kind(self) -> str:
        """The narrowest integer type for all components."""
        for kind in ("int16", "int32"):
            if np.iinfo(kind).min <= self.low and self.high <= np.iinfo(kind).max:
                return kind
        return "int64"

    @property
    def largest(self) -> int:
        return max(abs(self.low), abs(self.high))

    @property
    def real(self) -> type:
        """The narrowest type whose inner products of two such vectors are exact (by Cauchy-Schwarz)."""
        return np.float32 if self.squared < 1 << 24 else np.float64 if self.squared < 1 << 53 else object


def shape_of(df: DataFrame, column: str = "x") -> Shape:
    square = F.aggregate(column, F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(column)).alias("dim"), F.min(F.array_min(column)).alias("low"), F.max(F.array_max(column)).alias("high"), F.max(square).alias("squared")).first()
    return Shape(found.rows, found.dim or 0, found.low or 0, found.high or 0, found.squared or 0.0)


def matrix(lists: pa.Array, dim: int, kind: str = "int64") -> np.ndarray:
    """An Arrow list column as a matrix; shorter rows end in zeros."""
    sizes = np.asarray(lists.value_lengths()) if len(lists) else np.zeros(0, int)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim).astype(kind)
    out = np.zeros((len(sizes), dim), dtype=kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def binary(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """A binary column of equally wide rows as a matrix."""
    if not len(column) or not dim:
        return np.zeros((len(column), dim), dtype=kind)
    width = dim * np.dtype(kind).itemsize
    first = np.frombuffer(column.buffers()[1], dtype=np.int32, count=1, offset=4 * column.offset)[0]
    return np.frombuffer(column.buffers()[2], dtype=kind, count=len(column) * dim, offset=int(first)).reshape(len(column), dim) if width else np.zeros((len(column), 0), kind)


def packed(df: DataFrame, shape: Shape, column: str = "x") -> DataFrame:
    """The list column as a binary one, all rows of the same width."""
    dim, kind = shape.dim, shape.kind
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [binary(matrix(batch.column(n), dim, kind)) if n == column else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cells, names=names)

    schema = ", ".join(f"`{n}` {'binary' if n == column else t}" for n, t in df.dtypes)
    return map_batches(df, run, schema)
