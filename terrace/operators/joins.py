"""Checked equi joins, lookups with fallbacks and id-set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.quality import expect_unique
from terrace.operators.skew import attach


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    if check:
        expect_unique(left, keys)
        expect_unique(right, keys)
    return left.join(right, keys, "left")


def inner_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    if check:
        expect_unique(left, keys)
        expect_unique(right, keys)
    return left.join(right, keys, "inner")


def left_with_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    joined = left.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, fallback: dict[str, object]) -> DataFrame:
    """Dictionary-style lookup: unknown keys get the fallback."""
    joined = attach(rows, dim, keys, weight)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fallback.items()})


def hierarchical_lookup(
    rows: DataFrame, levels: list[tuple[str, DataFrame]], value: str, weight: str, overall: DataFrame, name: str
) -> DataFrame:
    """First available value along a chain of keys, then the one-row overall value.

    ``levels`` pairs a key column with its table (key, value, weight).
    """
    result = rows
    for i, (key, dim) in enumerate(levels):
        renamed = dim.select(key, F.col(value).alias(f"_l{i}"), F.col(weight).alias("_w"))
        result = attach(result, renamed, [key], "_w").drop("_w")
    one = overall.select(F.col(value).alias("_all"))
    chain = [F.col(f"_l{i}") for i in range(len(levels))]
    return (
        result.crossJoin(F.broadcast(one))
        .withColumn(name, F.coalesce(*chain, F.col("_all")))
        .drop(*[f"_l{i}" for i in range(len(levels))], "_all")
    )


def semi_by_ids(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids, keys, "left_semi")


def id_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids present on one side only, with the side that has them."""
    a = left.select(key).distinct().withColumn("_in_left", F.lit(1))
    b = right.select(key).distinct().withColumn("_in_right", F.lit(1))
    joined = a.join(b, key, "full")
    return joined.where(F.col("_in_left").isNull() | F.col("_in_right").isNull()).select(
        key, F.when(F.col("_in_left") == 1, F.lit("left_only")).otherwise(F.lit("right_only")).alias("side")
    )


def align_predictions(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Bring an external prediction table to the rows by id."""
    return rows.join(predictions, key, "inner")


def link_text(rows: DataFrame, source: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Attach source text by exact id; also returns a one-row audit.

    The audit counts source rows per id before joining, so it reports
    many-to-many keys without producing their pairs. Reading a linked row
    whose source id repeats is an error, as one of its texts would be a guess.
    """
    per_id = source.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"), F.min(text).alias(text))
    ids = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    matched = ids.join(per_id.select(key, "_copies"), key, "left")
    audit = matched.agg(
        F.sum("_rows").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_copies").isNotNull(), F.col("_rows"))), F.lit(0)).alias("linked"),
        F.coalesce(F.sum(F.when(F.col("_copies").isNull(), F.col("_rows"))), F.lit(0)).alias("missing"),
        (F.max("_rows") == 1).cast("int").alias("row_ids_unique"),
        (F.coalesce(F.max("_copies"), F.lit(1)) == 1).cast("int").alias("source_ids_unique"),
        F.count_if((F.col("_rows") > 1) & (F.col("_copies") > 1)).alias("many_to_many"),
    )
    message = F.concat(F.lit(f"the source repeats {key} "), F.col(key).cast("string"))
    sure = F.when(F.col("_copies") == 1, F.col(text)).otherwise(F.raise_error(message).cast("string"))
    linked = rows.join(per_id.withColumn(text, sure).drop("_copies"), key, "inner")
    return linked, audit


def cross_small(facts: DataFrame, *lists: tuple[str, list]) -> DataFrame:
    """Facts repeated for every combination of small literal lists."""
    result = facts
    for name, values in lists:
        result = result.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return result
