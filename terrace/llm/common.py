"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.session import durable as written  # noqa: F401

#: White space of the contracts: space and the five controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
#: Text bytes that one vectorised step looks at; bounds a Python worker's memory.
SLICE_BYTES = 1 << 19


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def body() -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


_SHIPPED: set[str] = set()


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` that first sends this package to the workers, once a context."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")).resolve() / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        # Workers live on; what a task used goes back.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges ``(start, end)`` of a batch, of up to ``rows`` rows, whose texts stay near ``SLICE_BYTES``; one long text may exceed it."""
    sizes = [0 if not v.is_valid else v.as_buffer().size for v in batch.column(column)]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > SLICE_BYTES or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BASE = np.uint64(0x5851F42D4C957F2D)
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the rolling base, modulo 2**64; grown by doubling."""
    global _POWERS
    while len(_POWERS) < n:
        step = np.multiply(_POWERS[-1], _BASE)
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums ``h`` with ``h[j] - h[i] * base**(j - i)`` the hash of bytes ``i..j`` (see :func:`span_hash`)."""
    codes = _BYTE_CODE[data]
    n = len(data)
    inverse = inverse_powers(n)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * inverse[:n], dtype=np.uint64)])


_INVERSE = np.ones(1, dtype=np.uint64)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    while len(_INVERSE) < n:
        step = np.multiply(_INVERSE[-1], _BASE_INVERSE)
        _INVERSE = np.concatenate([_INVERSE, _INVERSE * step])
    return _INVERSE


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans hash alike wherever they stand."""
    table = powers(int(end.max()) + 1 if len(end) else 1)
    return mix64((prefix[end] - prefix[start]) * table[end] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at :data:`WHITE`) of some texts, and the text number of each."""
    raw = [(t or "").encode() for t in texts]
    # A blank after each text ends its last word.
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends_at = np.cumsum([len(r) + 1 for r in raw])
    data = _LOWER[data]
    blank = _BLANK[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = not blank[0], False
    edge[1:-1] = blank[1:] != blank[:-1]
    bounds = np.flatnonzero(edge)
    start, end = bounds[0::2], bounds[1::2]
    return span_hash(rolling(data), start, end), np.searchsorted(ends_at, start, side="right")
