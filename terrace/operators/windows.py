"""Ranks, best rows, deltas against a baseline and set operations on reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.order import running_totals
from terrace.operators.skew import group_sizes


def rank_min(df: DataFrame, metric: str, partition: list[str] | None = None, name: str | None = None, descending: bool = False) -> DataFrame:
    """Competition rank of a report metric, optionally per scenario."""
    order = F.desc(metric) if descending else F.asc(metric)
    window = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(order)
    return df.withColumn(name or f"{metric}_rank", F.rank().over(window))


def group_size(df: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    return group_sizes(df, keys, name)


def candidate_rank(df: DataFrame, candidate: str, partition: list[str] | None = None) -> DataFrame:
    """Rank by RMSE up, MAE up, R2 down, then candidate id."""
    window = Window.partitionBy(*(partition or [F.lit(1)])).orderBy("rmse", "mae", F.desc("r2"), candidate)
    ranked = df.withColumn("rank", F.row_number().over(window))
    return ranked.withColumn("selected", (F.col("rank") == 1).cast("int"))


def best_row(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def combined_rank_best(df: DataFrame, row_id: str) -> DataFrame:
    """Smallest sum of RMSE and MAE ranks; first id on a tie."""
    both = rank_min(rank_min(df, "rmse"), "mae")
    total = F.col("rmse_rank") + F.col("mae_rank")
    return both.withColumn("combined_rank", total).orderBy("combined_rank", row_id).limit(1)


def top_n(df: DataFrame, column: str, n: int, tiebreak: str) -> DataFrame:
    return df.orderBy(F.desc(column), tiebreak).limit(n)


def sort_stable(df: DataFrame, keys: list[str | Column], tiebreak: str) -> DataFrame:
    return df.orderBy(*keys, tiebreak)


def cumulative_sum(df: DataFrame, order: str, value: str, name: str = "cumulative") -> DataFrame:
    """Running sum in the order of a unique numeric key, bucketed."""
    totals = running_totals(df, [], order, value)
    return totals.withColumn(name, F.col("_before") + F.col(value)).drop("_before", "_total")


def delta_vs_baseline(df: DataFrame, partition: list[str], level: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Each report row minus its model's baseline row, absolute and percent."""
    window = Window.partitionBy(*partition)
    result = df
    for m in metrics:
        base = F.max(F.when(F.col(level) == baseline, F.col(m))).over(window)
        result = result.withColumn(f"{m}_change", F.col(m) - base).withColumn(
            f"{m}_change_pct", (F.col(m) - base) / base * 100.0
        )
    return result


def fold_wins(fold_metrics: DataFrame, model: str, a: str, b: str, metrics: list[str], fold: str = "fold") -> DataFrame:
    """Number of folds in which ``a`` beats ``b`` on each metric."""
    x = fold_metrics.where(F.col(model) == a).select(fold, *[F.col(m).alias(f"_a_{m}") for m in metrics])
    y = fold_metrics.where(F.col(model) == b).select(fold, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    return x.join(y, fold).agg(
        *[F.count_if(F.col(f"_a_{m}") < F.col(f"_b_{m}")).alias(f"{m}_wins") for m in metrics],
        F.count(F.lit(1)).alias("folds"),
    )


def balanced_score_best(df: DataFrame, reference: DataFrame, metrics: list[str], row_id: str) -> DataFrame:
    """Row with the smallest sum of metrics, each divided by its reference value."""
    one = reference.select(*[F.col(m).alias(f"_ref_{m}") for m in metrics])
    score = sum((F.col(m) / F.col(f"_ref_{m}") for m in metrics[1:]), F.col(metrics[0]) / F.col(f"_ref_{metrics[0]}"))
    return (
        df.crossJoin(F.broadcast(one)).withColumn("balanced_score", score)
        .drop(*[f"_ref_{m}" for m in metrics]).orderBy("balanced_score", row_id).limit(1)
    )


def union_long(*tables: DataFrame) -> DataFrame:
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t, allowMissingColumns=True)
    return result


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of union, intersection and both differences of two id sets."""
    a = left.select(key).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
    b = right.select(key).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    sides = a.unionByName(b).groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.agg(
        F.count(F.lit(1)).alias("union_ids"),
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("common_ids"),
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 0)).alias("left_only_ids"),
        F.count_if((F.col("_l") == 0) & (F.col("_r") == 1)).alias("right_only_ids"),
    )
