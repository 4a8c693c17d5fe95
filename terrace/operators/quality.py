"""Table expectations: each is one small aggregate checked on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.parse import as_number, finite


class ExpectationError(ValueError):
    """A table does not meet a stated expectation."""


def require_columns(df: DataFrame, required) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ExpectationError(f"missing required columns: {missing}")


def validate_raw(df: DataFrame, required) -> DataFrame:
    """Required columns and rows present; returns rows, columns, exact duplicates."""
    require_columns(df, required)
    if df.isEmpty():
        raise ExpectationError("the table has no rows")
    return raw_profile(df)


def raw_profile(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.sum(F.col("_n") - 1).alias("duplicate_rows")
    )


def sanitize(df: DataFrame, target: str, numeric: list[str], others: list[str]) -> DataFrame:
    """Typed finite numbers and a present target; fails when nothing is left."""
    require_columns(df, [target, *numeric, *others])
    clean = sanitized(df, target, numeric, others)
    if clean.isEmpty():
        raise ExpectationError("no rows with a finite numeric target")
    return clean


def sanitized(df: DataFrame, target: str, numeric: list[str], others: list[str]) -> DataFrame:
    numbers = {c: finite(as_number(F.col(c).cast("string"))) for c in [target, *numeric]}
    return df.select(target, *numeric, *others).withColumns(numbers).dropna(subset=[target])


def _infinite(c: str) -> Column:
    return F.abs(F.col(c).cast("double")) == F.lit(float("inf"))


def prepared_report(df: DataFrame, target: str, numeric: list[str], keys: list[str]) -> DataFrame:
    """Counts by reason in one pass, plus duplicates."""
    t = F.col(target).cast("double")
    bad = [F.coalesce(_infinite(c), F.lit(False)) for c in numeric]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(t.isNull() | F.isnan(t)).alias("target_missing"),
        F.count_if(F.abs(t) == F.lit(float("inf"))).alias("target_infinite"), F.count_if(t <= 0).alias("target_nonpositive"),
        F.count_if(any_bad).alias("rows_with_infinite"),
        sum((F.count_if(F.col(c).isNull()) for c in numeric[1:]), F.count_if(F.col(numeric[0]).isNull())).alias("missing_cells"),
    )
    duplicates = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
    )
    return counts.crossJoin(duplicates)


def validate_prepared(df: DataFrame, target: str, numeric: list[str], keys: list[str]) -> DataFrame:
    report = prepared_report(df, target, numeric, keys)
    row = report.first()
    problems = [c for c in ("target_missing", "target_infinite", "target_nonpositive", "rows_with_infinite") if row[c]]
    if problems:
        raise ExpectationError(f"prepared table fails: {problems}")
    return report


def positive_finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(
            F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | _infinite(c) | (F.col(c) <= 0)
        ).alias("violations")) for c in columns
    ]).alias("_v"))
    return one.select(F.explode("_v").alias("v")).select("v.*")


def expect_positive_finite(df: DataFrame, columns: list[str]) -> None:
    bad = positive_finite_report(df, columns).where("violations > 0").collect()
    if bad:
        raise ExpectationError(f"not positive and finite: {[r['column'] for r in bad]}")


def expect_row_count(df: DataFrame, expected: int) -> int:
    found = df.count()
    if found != expected:
        raise ExpectationError(f"expected {expected} rows, found {found}")
    return found


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def expect_unique(df: DataFrame, keys: list[str]) -> None:
    first = repeated_keys(df, keys).limit(1).collect()
    if first:
        raise ExpectationError(f"key {keys} repeats: {first[0].asDict()}")


def partition_report(df: DataFrame, row_id: str, fold: str, k: int) -> DataFrame:
    """Per fold: validation and training rows, plus identities that must hold.

    Rows are counted per id first, so overlap and repeats show up as numbers.
    """
    per_id = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(fold).alias("_folds"))
    ids = per_id.agg(
        F.count(F.lit(1)).alias("ids"), F.count_if(F.col("_rows") != 1).alias("ids_not_once"),
    )
    folds = df.groupBy(fold).agg(F.count(F.lit(1)).alias("validation_rows"))
    return folds.crossJoin(F.broadcast(ids)).withColumn("training_rows", F.col("ids") - F.col("validation_rows")).withColumn(
        "trained_times", F.lit(k - 1)
    )


def expect_partition(df: DataFrame, row_id: str, fold: str, k: int) -> None:
    one = partition_report(df, row_id, fold, k).agg(
        F.max("ids_not_once").alias("bad"), F.sum("validation_rows").alias("validated"), F.max("ids").alias("ids"),
        F.sum("training_rows").alias("trained"), F.count(F.lit(1)).alias("folds"),
    ).first()
    if one["bad"] or one["validated"] != one["ids"] or one["folds"] != k or one["trained"] != (k - 1) * one["ids"]:
        raise ExpectationError(f"folds do not partition the rows: {one.asDict()}")


def groups_crossing_folds(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups found in more than one fold; must be empty for group-safe folds."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def fold_set_report(scored: DataFrame, row_id: str, fold: str) -> DataFrame:
    """Fold numbers in use, and ids whose fold differs between models."""
    folds = scored.select(fold).distinct().agg(F.array_join(F.sort_array(F.collect_set(F.col(fold).cast("int"))), ",").alias("folds"))
    moved = scored.groupBy(row_id).agg(F.count_distinct(fold).alias("_f")).agg(F.count_if(F.col("_f") > 1).alias("ids_with_several_folds"))
    return folds.crossJoin(moved)


def expect_fold_set(scored: DataFrame, row_id: str, fold: str, k: int) -> None:
    row = fold_set_report(scored, row_id, fold).first()
    wanted = ",".join(str(i) for i in range(1, k + 1))
    if row["folds"] != wanted or row["ids_with_several_folds"]:
        raise ExpectationError(f"unexpected folds: {row.asDict()}")


def oof_coverage(scored: DataFrame, row_id: str, rows: DataFrame) -> DataFrame:
    """Per model: ids scored once, repeated, non-finite, missing from or foreign to the table."""
    ids = rows.select(row_id).withColumn("_known", F.lit(1))
    bad = F.col("predicted").isNull() | F.isnan("predicted") | (F.abs("predicted") == F.lit(float("inf")))
    per = scored.groupBy("model", row_id).agg(F.count(F.lit(1)).alias("_n"), F.max(bad.cast("int")).alias("_bad"))
    joined = per.join(ids, row_id, "left")
    report = joined.groupBy("model").agg(
        F.count(F.lit(1)).alias("ids"), F.count_if(F.col("_n") > 1).alias("repeated"),
        F.count_if(F.col("_bad") == 1).alias("non_finite"), F.count_if(F.col("_known").isNull()).alias("foreign_ids"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("_rows"))
    return report.crossJoin(F.broadcast(total)).withColumn(
        "unscored", F.col("_rows") - (F.col("ids") - F.col("foreign_ids"))
    ).drop("_rows")


def grid_report(scored: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Rows per (model, level) cell, how many cells differ from the first, and missing cells."""
    cells = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return cells.agg(
        F.count(F.lit(1)).alias("cells"), (F.lit(expected) - F.count(F.lit(1))).alias("missing_cells"),
        F.min("_n").alias("smallest"), F.max("_n").alias("largest"),
    )


def expect_oof_coverage(scored: DataFrame, row_id: str, rows: DataFrame) -> None:
    bad = oof_coverage(scored, row_id, rows).where("repeated + non_finite + foreign_ids + unscored > 0").collect()
    if bad:
        raise ExpectationError(f"incomplete predictions: {[r.asDict() for r in bad]}")


def metrics_match(recomputed: DataFrame, saved: DataFrame, keys: list[str], metrics: list[str], atol: float = 1e-6, rtol: float = 1e-9) -> DataFrame:
    """Largest gap per report row between recomputed and saved metrics."""
    right = saved.select(*keys, *[F.col(m).alias(f"_saved_{m}") for m in metrics])
    joined = recomputed.select(*keys, *metrics).join(right, keys, "full")
    ok = F.lit(True)
    gap = F.lit(0.0)
    for m in metrics:
        d = F.abs(F.col(m) - F.col(f"_saved_{m}"))
        ok = ok & F.coalesce(d <= atol + rtol * F.abs(f"_saved_{m}"), F.lit(False))
        gap = F.greatest(gap, d)
    return joined.select(*keys, gap.alias("largest_gap"), ok.cast("int").alias("reproduced"))


def split_groups(fine: DataFrame, coarse: DataFrame, row_id: str, group: str) -> DataFrame:
    """Groups of the finer scenario that the coarser one splits; must be empty."""
    a = fine.select(row_id, F.col(group).alias("fine_group"))
    b = coarse.select(row_id, F.col(group).alias("_coarse"))
    return a.join(b, row_id).groupBy("fine_group").agg(F.count_distinct("_coarse").alias("parts")).where("parts > 1")


def leakage_audit(scored: DataFrame, group: str, fold: str = "fold", by: list[str] | None = None) -> DataFrame:
    """Per model and fold: groups validated there that also train there.

    A group leaks into fold k when it has rows in k and elsewhere, so one
    count of folds per group is enough.
    """
    by = by or []
    cells = scored.select(*by, group, fold).distinct()
    spread = cells.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_folds"), F.collect_set(fold).alias("_set"))
    exploded = spread.select(*by, F.explode("_set").alias(fold), (F.col("_folds") > 1).alias("_leaks"))
    return exploded.groupBy(*by, fold).agg(
        F.count(F.lit(1)).alias("validation_groups"), F.count_if(F.col("_leaks")).alias("overlapping_groups")
    )


def input_errors(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Blocking problems of batch inputs as an array of messages."""
    n = {c: as_number(F.col(c).cast("string")) for c in numeric}
    missing = [
        F.when(n[c].isNull() | F.isnan(n[c]) | (F.abs(n[c]) == F.lit(float("inf"))), F.lit(f"{c} must be a finite number")) for c in numeric
    ]
    logic = []
    if "property_size_sqft" in n:
        logic.append(F.when(n["property_size_sqft"] <= 0, F.lit("property_size_sqft must be greater than zero")))
    for c in ("bedroom", "bathroom", "parking_lot", "facilities_count"):
        if c in n:
            logic.append(F.when(n[c] < 0, F.lit(f"{c} cannot be negative")))
    if "completion_year" in n:
        logic.append(F.when(~n["completion_year"].between(1800, 2030), F.lit("completion_year must be between 1800 and 2030")))
    for c in ("number_of_floors", "total_units"):
        if c in n:
            logic.append(F.when(n[c] <= 0, F.lit(f"{c} must be greater than zero")))
    first = F.filter(F.array(*missing), lambda x: x.isNotNull())
    second = F.filter(F.array(*logic), lambda x: x.isNotNull())
    return df.withColumn("errors", F.when(F.size(first) > 0, first).otherwise(second))


def outside_ranges(df: DataFrame, ranges: DataFrame, numeric: list[str]) -> DataFrame:
    """Fields outside the range seen in the reference table (one row per field)."""
    one = ranges.groupBy().agg(
        *[F.max(F.when(F.col("field") == c, F.col("minimum"))).alias(f"_lo_{c}") for c in numeric],
        *[F.max(F.when(F.col("field") == c, F.col("maximum"))).alias(f"_hi_{c}") for c in numeric],
    )
    joined = df.crossJoin(F.broadcast(one))
    marks = [F.when((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}")), F.lit(c)) for c in numeric]
    kept = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return joined.withColumn("outside_range", kept).drop(*[f"_{s}_{c}" for s in ("lo", "hi") for c in numeric])
