"""Folds, splits, trims and winsorizing. Hashes are md5 so any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.filters import training_copies
from terrace.operators.order import hashed_rank, null_safe_join, quantiles, training_quantiles
from terrace.operators.skew import attach, group_sizes
from terrace.session import durable


def salted(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_number(key: Column, seed: int) -> Column:
    """Uniform 32-bit number of a key."""
    return F.conv(F.substring(salted(key, seed), 1, 8), 16, 10).cast("long")


def hash_fold(key: Column, k: int, seed: int) -> Column:
    return (hash_number(key, seed) % k + 1).cast("int")


def assign_kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, balanced: bool = True) -> DataFrame:
    """Shuffled folds 1..k. ``balanced`` keeps sizes within one row of each other.

    The balanced form deals rows out in digest order; the plain form is a pure
    expression without a shuffle.
    """
    if not balanced:
        return df.withColumn("fold", hash_fold(F.col(key), k, seed))
    ranked = hashed_rank(df.withColumn("_digest", salted(F.col(key), seed)), "_digest", "_position")
    return ranked.withColumn("fold", (F.col("_position") % k + 1).cast("int")).drop("_digest", "_position")


def assign_group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Whole group in one fold; an expression, so no shuffle at any scale."""
    return df.withColumn("fold", hash_fold(F.col(group), k, seed))


def assign_group_kfold_balanced(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Whole groups in one fold, dealt by falling size: fold sizes differ by no more rows than the largest group has.

    Groups of one size are a class, in digest order; classes follow each other
    from the largest size down, and the folds take groups in turn, forwards
    and backwards. A group's turn is its rank in its class plus the groups of
    larger classes, which come from a histogram of sizes (at most about the
    square root of twice the rows), so no list of groups is gathered or
    sorted whole. A missing group is one group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_digest", salted(F.col(group), seed))
    ranked = durable(hashed_rank(sizes, "_digest", "_rank", ["_n"]))
    larger = Window.partitionBy(F.lit(1)).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    classes = ranked.groupBy("_n").agg(F.count(F.lit(1)).alias("_groups")).select("_n", F.coalesce(F.sum("_groups").over(larger), F.lit(0)).alias("_ahead"))
    turn = (F.col("_ahead") + F.col("_rank")) % (2 * k)
    fold = F.when(turn < k, turn + 1).otherwise(2 * k - turn).cast("int")
    dealt = ranked.join(F.broadcast(classes), "_n").select(group, fold.alias("fold"), "_n")
    return attach(df, dealt, [group], "_n").drop("_n")


def inner_folds(df: DataFrame, key: str, k: int, seed: int, folds: int = 5) -> DataFrame:
    """Nested folds: each outer training copy gets an inner fold of its own."""
    copies = training_copies(df, "fold", folds)
    combined = F.concat_ws("|", F.col("outer_fold").cast("string"), F.col(key).cast("string"))
    return copies.withColumn("inner_fold", hash_fold(combined, k, seed + 1))


def train_test_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Deterministic split by hash threshold."""
    cut = int(share * 2**32)
    return df.withColumn("split", F.when(hash_number(F.col(key), seed) < cut, "test").otherwise("train"))


def fold_assignment_table(df: DataFrame, scenario: str, row_id: str, order: str) -> DataFrame:
    """Scenario, row, group, repeat group, repeat flag, group size and fold."""
    sized = df if "group_size" in df.columns else group_sizes(df, ["group_id"], "group_size")
    return sized.select(
        F.lit(scenario).alias("scenario"), F.col(order).alias("row_index"), row_id, "group_id", "repeat_group_id",
        "is_grouped_repeat", F.col("group_size").cast("long").alias("group_size"), "fold",
    )


# Trim level and percent of the upper tail removed.
TRIM_LEVELS = (("A", 0.0), ("B", 0.5), ("C", 1.0), ("D", 2.5), ("E", 5.0), ("F", 10.0))


def _cutoff_columns(levels) -> dict[str, float]:
    return {f"_cut_{name}": 1.0 - pct / 100.0 for name, pct in levels if pct > 0}


def _level_structs(levels) -> Column:
    return F.array(*[
        F.struct(
            F.lit(name).alias("trim_level"), F.lit(float(pct)).alias("removal_pct"),
            (F.col(f"_cut_{name}") if pct > 0 else F.lit(None).cast("double")).alias("cutoff"),
        ) for name, pct in levels
    ])


def tail_trim_cutoffs(df: DataFrame, value: str, levels=TRIM_LEVELS, folds: int = 5) -> DataFrame:
    """Per level and fold, the cut-off learnt from training rows only.

    Counts come from (fold, value) totals, so the table is read once and the
    five training copies are made of counts, not of rows.
    """
    counts = durable(df.groupBy("fold", value).agg(F.count(F.lit(1)).alias("_k")), "counts")
    cuts = training_quantiles(df, value, _cutoff_columns(levels), folds=folds)
    per_level = cuts.select("outer_fold", F.explode(_level_structs(levels)).alias("_l")).select("outer_fold", "_l.*")
    joined = training_copies(counts.withColumnRenamed("_k", "_n"), "fold", folds).join(F.broadcast(per_level), "outer_fold")
    kept = F.col("cutoff").isNull() | (F.col(value) <= F.col("cutoff"))
    grouped = joined.groupBy("trim_level", "removal_pct", "outer_fold").agg(
        F.sum("_n").alias("training_rows_before"),
        F.coalesce(F.sum(F.when(~kept, F.col("_n"))), F.lit(0)).alias("training_rows_removed"),
        F.sum(F.when(kept, F.col("_n"))).alias("training_rows_retained"),
        F.max("cutoff").alias("cutoff"),
        F.max(F.when(kept, F.col(value))).alias("max_retained"),
    )
    validation = counts.groupBy("fold").agg(F.sum("_k").alias("validation_rows"))
    return grouped.withColumnRenamed("outer_fold", "fold").join(F.broadcast(validation), "fold").select(
        "trim_level", "removal_pct", "fold", "training_rows_before", "training_rows_removed", "training_rows_retained",
        (F.col("training_rows_removed") * 100.0 / F.col("training_rows_before")).alias("actual_removal_pct"),
        "cutoff", "max_retained", "validation_rows", F.lit(0).alias("validation_rows_removed"),
    )


def population_trim(df: DataFrame, value: str, levels=TRIM_LEVELS) -> DataFrame:
    """Rows repeated per level with the full-population cut-off and a kept flag."""
    cuts = quantiles(df, [], value, _cutoff_columns(levels))
    joined = df.crossJoin(F.broadcast(cuts)).withColumn("_l", F.explode(_level_structs(levels)))
    cutoff = F.col("_l.cutoff")
    return joined.select(
        *df.columns, "_l.trim_level", "_l.removal_pct", cutoff.alias("cutoff"),
        (cutoff.isNull() | (F.col(value) <= cutoff)).cast("int").alias("retained"),
    )


def retained_cv_summary(df: DataFrame, value: str, levels=TRIM_LEVELS) -> DataFrame:
    """Per level and fold: original, retained, removed, training and validation rows."""
    flagged = population_trim(df.select("fold", value), value, levels)
    by_fold = flagged.groupBy("trim_level", "removal_pct", "fold").agg(
        F.count(F.lit(1)).alias("original_rows"), F.sum("retained").alias("retained_rows")
    )
    totals = by_fold.groupBy("trim_level").agg(F.sum("retained_rows").alias("_kept"))
    return by_fold.join(F.broadcast(totals), "trim_level").select(
        "trim_level", "removal_pct", "fold", "original_rows", "retained_rows",
        (F.col("original_rows") - F.col("retained_rows")).alias("removed_rows"),
        (F.col("_kept") - F.col("retained_rows")).alias("training_rows"),
        F.col("retained_rows").alias("validation_rows"),
        (F.col("retained_rows") * 100.0 / F.col("original_rows")).alias("retention_pct"),
    )


# Winsorizing settings (name, lower quantile, upper quantile).
WINSOR_SETTINGS = (
    ("winsor_0_5_99_5", 0.005, 0.995), ("winsor_1_99", 0.01, 0.99), ("winsor_2_5_97_5", 0.025, 0.975),
    ("winsor_5_95", 0.05, 0.95), ("upper_99_only", None, 0.99), ("upper_97_5_only", None, 0.975),
)


def check_winsor(lower: float | None, upper: float | None) -> None:
    for q in (lower, upper):
        if q is not None and not 0.0 <= q <= 1.0:
            raise ValueError("winsor quantiles must lie between 0 and 1")
    if lower is not None and upper is not None and lower >= upper:
        raise ValueError("the lower quantile must be below the upper one")


def winsor_bounds(df: DataFrame, value: str, settings=WINSOR_SETTINGS, folds: int = 5) -> DataFrame:
    """Bounds and clipped counts per setting and outer fold, from training rows."""
    for _, lo, hi in settings:
        check_winsor(lo, hi)
    rows = durable(df.select("fold", value), "values")
    wanted = {f"_{n}_{side}": q for n, lo, hi in settings for side, q in (("lo", lo), ("hi", hi)) if q is not None}
    bounds = training_quantiles(rows, value, wanted, folds=folds)
    copies = training_copies(rows, "fold", folds).join(F.broadcast(bounds), "outer_fold")
    # Every row meets the bounds of all settings at once; only one line a fold leaves a task.
    clipped = {f"{n}_{side}": F.col(value) < F.col(f"_{n}_lo") if side == "lo" else F.col(value) > F.col(f"_{n}_hi") for n, lo, hi in settings for side, q in (("lo", lo), ("hi", hi)) if q is not None}
    totals = copies.groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max(b).alias(b) for b in wanted], *[F.count_if(hit).alias(n) for n, hit in clipped.items()]
    )
    return totals.select(F.col("outer_fold").alias("fold"), F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("setting"),
            (F.col(f"_{n}_lo") if lo is not None else F.lit(None).cast("double")).alias("lower_bound"),
            (F.col(f"_{n}_hi") if hi is not None else F.lit(None).cast("double")).alias("upper_bound"),
            (F.col(f"{n}_lo") if lo is not None else F.lit(0)).cast("long").alias("lower_clipped"),
            (F.col(f"{n}_hi") if hi is not None else F.lit(0)).cast("long").alias("upper_clipped"),
            F.col("_rows").alias("training_rows"),
        ) for n, lo, hi in settings
    ]))).select("setting", "fold", "lower_bound", "upper_bound", "lower_clipped", "upper_clipped", "training_rows")


def winsorize(df: DataFrame, value: str, lower: float | None, upper: float | None, folds: int = 5) -> DataFrame:
    """Training copies with the value clipped to that fold's bounds; no row is removed."""
    copies = training_copies(df, "fold", folds)
    check_winsor(lower, upper)
    wanted = {n: q for n, q in (("lower_bound", lower), ("upper_bound", upper)) if q is not None}
    bounds = training_quantiles(df, value, wanted, folds=folds)
    joined = null_safe_join(copies, F.broadcast(bounds), ["outer_fold"])
    clipped = F.col(value)
    if lower is not None:
        clipped = F.greatest(clipped, F.col("lower_bound"))
    if upper is not None:
        clipped = F.least(clipped, F.col("upper_bound"))
    return joined.withColumn(f"{value}_clipped", clipped).drop(*wanted)


def fold_premium_labels(df: DataFrame, value: str, q: float, folds: int = 5) -> DataFrame:
    """Every row for every outer fold, labelled by that fold's training quantile."""
    bounds = training_quantiles(df, value, {"threshold": q}, folds=folds)
    copies = df.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    joined = null_safe_join(copies, F.broadcast(bounds), ["outer_fold"])
    return joined.withColumn("is_premium", (F.col(value) >= F.col("threshold")).cast("int")).withColumn(
        "role", F.when(F.col("fold") == F.col("outer_fold"), "validation").otherwise("train")
    )


def attach_folds(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    dim = assignment.groupBy(key).agg(F.min("fold").alias("fold"), F.count(F.lit(1)).alias("_n"))
    return attach(df, dim, [key], "_n").drop("_n")
