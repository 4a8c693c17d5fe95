"""Attach per-key results to rows when one key may own a third of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from terrace.session import durable

HOT_KEYS = 256
SALTS = 64
BROADCAST_BYTES = 32 * 1024 * 1024


def row_bytes(kind: DataType) -> int:
    """Rough size of one value, on the high side."""
    if isinstance(kind, StructType):
        return sum(row_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return 32 * row_bytes(kind.elementType)
    return 96 if isinstance(kind, StringType) else 16


def attach(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, keyed: DataFrame | None = None) -> DataFrame:
    """Left join a one-row-per-key table; its columns, ``weight`` among them, stand behind the rows'.

    The table is written once to the shared folder and measured. One that fits
    ``BROADCAST_BYTES`` is broadcast, and the rows do not move. Otherwise the
    frequent keys of the rows, in the table or not, NULL or not, are found
    with a bounded summary: their table entries (one each) are broadcast and
    their rows are spread over salts in the shuffle join that serves the other
    keys, so no reducer receives a hot key whole.

    NULL keys match NULL keys. A row column named like a value of the table is
    an error: one of the two would be lost.

    ``keyed`` is a written table in which the rows' frequent keys are frequent
    too; the summary reads it in place of rows that are dear to compute.
    """
    values = [c for c in dim.columns if c not in keys]
    if clash := sorted(set(values) & set(rows.columns)):
        raise ValueError(f"the rows have columns of the names {clash}")
    dim = durable(dim)
    key_copies = [f"_k_{k}" for k in keys]
    packed = dim.select(*[F.col(k).alias(c) for k, c in zip(keys, key_copies)], F.struct(*values).alias("_packed"), F.col(weight).alias("_w"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, key_copies)])
    if dim.count() * row_bytes(dim.schema) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(packed.drop("_w")), match, "left").select(*rows.columns, *[F.col(f"_packed.{v}").alias(v) for v in values])
    # A Misra-Gries summary: at most HOT_KEYS hashes, none that a larger share of the rows has is missing.
    hashed = (rows if keyed is None else keyed).select(F.xxhash64(*keys).alias("_h"))
    frequent = hashed.freqItems(["_h"], 1.0 / HOT_KEYS).first()[0] or [0]
    is_hot = F.xxhash64(*key_copies).isin(frequent)
    hot = packed.where(is_hot).drop("_w").withColumnRenamed("_packed", "_hot")
    # The salt of the table side reads a column: a literal would be folded out
    # of the join keys, and hot rows would meet in one reducer again.
    zero = F.when(F.col("_w") < 0, F.lit(-1)).otherwise(F.lit(0))
    cold = packed.where(~is_hot).withColumn("_dim_salt", zero).drop("_w").withColumnRenamed("_packed", "_cold")
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int") + 1
    first = rows.join(F.broadcast(hot), match, "left").drop(*key_copies)
    salted = first.withColumn("_salt", F.when(F.xxhash64(*keys).isin(frequent), spread).otherwise(F.lit(0)))
    joined = salted.join(cold, match & (F.col("_salt") == F.col("_dim_salt")), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])


def group_sizes(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Row count of each row's key group, next to the row."""
    dim = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return attach(rows, dim, keys, name)
