"""Grouped aggregates, distributions, missingness and shape summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numeric import bias_corrected_skew
from terrace.functions.parse import is_missing, strip
from terrace.operators.filters import missing_count
from terrace.operators.order import null_safe_join, quantiles, running_totals, value_counts, with_quantiles
from terrace.operators.skew import attach

ROOT_TWO_PI = math.sqrt(2.0 * math.pi)


def group_mean_count(df: DataFrame, key: str, value: str, minimum: int = 1) -> DataFrame:
    return (
        df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
        .where(F.col("count") >= minimum).orderBy("mean", key)
    )


def group_mean_median_count(df: DataFrame, key: str, value: str, minimum: int = 1) -> DataFrame:
    """Mean and median per key in long form: (key, count, statistic, value)."""
    base = df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    wide = with_quantiles(base.where(F.col("count") >= minimum), df, [key], value, {"median": 0.5})
    return wide.unpivot([key, "count"], ["mean", "median"], "statistic", "value")


def group_median_count(df: DataFrame, keys: list[str], value: str, minimum: int = 1) -> DataFrame:
    base = df.groupBy(*keys).agg(F.count(value).alias("count")).where(F.col("count") >= minimum)
    return with_quantiles(base, df, keys, value, {"median": 0.5})


def group_median_complete(df: DataFrame, column: str, labels: list[str], value: str) -> DataFrame:
    """Every label appears, in order, even without rows."""
    spark = df.sparkSession
    dim = spark.createDataFrame(list(enumerate(labels)), f"band_order int, {column} string")
    found = group_median_count(df, [column], value)
    return F.broadcast(dim).join(found, column, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def pivot_median(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Median per cell with a fixed column order; empty cells are NULL."""
    cells = quantiles(df.where(F.col(column).isin(*values)), [row, column], value, {"median": 0.5})
    return cells.groupBy(row).pivot(column, values).agg(F.first("median"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    base = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return with_quantiles(base, long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Profile of one column with p95 and bias-corrected skew."""
    by = by or []
    base = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), bias_corrected_skew(value).alias("skew"),
    )
    return with_quantiles(base, df, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})


def price_distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    base = df.groupBy(*by).agg(
        F.count(value).alias("rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.max(value).alias("max"), bias_corrected_skew(value).alias("skew"),
    )
    return with_quantiles(base, df, by, value, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


# Descriptive price bands (name, lower quantile, upper quantile).
PRICE_BANDS = (("P00_P95", 0.0, 0.95), ("P95_P99", 0.95, 0.99), ("P99_P100", 0.99, 1.0))


def quantile_bands(df: DataFrame, value: str, bands=PRICE_BANDS, name: str = "band") -> DataFrame:
    """Label rows by quantile band and keep the boundaries; the last band is closed."""
    wanted = {f"_q{i}_{side}": q for i, (_, lo, hi) in enumerate(bands) for side, q in (("lo", lo), ("hi", hi))}
    edges = quantiles(df, [], value, wanted)
    joined = df.crossJoin(F.broadcast(edges))
    label = lower = upper = None
    for i, (text, _, hi) in enumerate(bands):
        lo_c, hi_c = F.col(f"_q{i}_lo"), F.col(f"_q{i}_hi")
        inside = (F.col(value) >= lo_c) & ((F.col(value) <= hi_c) if hi == 1.0 else (F.col(value) < hi_c))
        label = F.when(inside, F.lit(text)) if label is None else label.when(inside, F.lit(text))
        lower = F.when(inside, lo_c) if lower is None else lower.when(inside, lo_c)
        upper = F.when(inside, hi_c) if upper is None else upper.when(inside, hi_c)
    return (
        joined.withColumn(name, label).withColumn("lower_bound", lower).withColumn("upper_bound", upper)
        .drop(*wanted)
    )


def missing_sums(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.sum(is_missing(df, c).cast("int")).cast("long").alias(c) for c in columns]


def dataset_profile(df: DataFrame, distinct: str, row_id: str | None = None) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, distinct values of a column."""
    nulls = df.agg(
        F.count(F.lit(1)).alias("rows"),
        sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull())).alias("missing_total"),
        F.count_distinct(distinct).alias(f"{distinct}_unique_count"),
    )
    result = nulls.crossJoin(_duplicates(df, df.columns, "duplicate_rows"))
    if row_id is not None:
        rest = [c for c in df.columns if c != row_id]
        result = result.crossJoin(_duplicates(df, rest, "duplicate_rows_excluding_id"))
    return result.withColumn("columns", F.lit(len(df.columns)))


def _duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing cells: (column, missing)."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "missing").where("missing > 0")


def stage_overview(stages: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows, columns, missing cells and duplicates per processing stage."""
    result = None
    for order, (name, df) in enumerate(stages.items()):
        cells = df.agg(
            F.count(F.lit(1)).alias("rows"),
            sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull())).alias("missing_cells"),
        )
        duplicates = _duplicates(df, (keys or {}).get(name, df.columns), "duplicate_rows")
        one = cells.crossJoin(duplicates).select(
            F.lit(order).alias("stage_order"), F.lit(name).alias("stage"), "rows",
            F.lit(len(df.columns)).alias("columns"), "missing_cells", "duplicate_rows",
        )
        result = one if result is None else result.unionByName(one)
    return result


def missing_pct(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *missing_sums(df, columns))
    long = one.unpivot(["_rows"], columns, "column", "missing")
    return long.where("missing > 0").select(
        "column", (F.col("missing") * 100.0 / F.col("_rows")).alias("missing_pct")
    ).orderBy(F.desc("missing_pct"), "column")


def missingness_summary(df: DataFrame, columns: list[str], important: list[str]) -> DataFrame:
    """Missing, present and zero counts per column; zero is not missing."""
    kinds = dict(df.dtypes)
    entries = []
    for i, c in enumerate(columns):
        zero = F.lit(None).cast("long") if kinds[c] == "string" else F.count_if(F.col(c) == 0)
        entries.append(
            F.struct(
                F.lit(c).alias("feature"), F.lit(i).alias("feature_order"),
                F.lit(int(c in important)).alias("important_feature"),
                F.count_if(is_missing(df, c)).alias("missing_count"),
                F.count_if(~is_missing(df, c)).alias("non_missing_count"), zero.alias("zero_count"),
            )
        )
    one = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*entries).alias("_e"))
    return one.select("_rows", F.explode("_e").alias("e")).select(
        "e.*", (F.col("e.missing_count") * 100.0 / F.col("_rows")).alias("missing_pct")
    )


def missingness_by_group(df: DataFrame, dims: list[str], columns: list[str]) -> DataFrame:
    """Missingness per value of several dimensions, from one grouping-sets pass."""
    flags = [is_missing(df, c).cast("int").alias(f"_m_{c}") for c in columns]
    labels = [F.coalesce(F.col(d).cast("string"), F.lit("<NA>")).alias(f"_d_{d}") for d in dims]
    prepared = df.select(*labels, *flags).withColumn("_missing", sum((F.col(f"_m_{c}") for c in columns[1:]), F.col(f"_m_{columns[0]}")))
    names = [f"_d_{d}" for d in dims]
    sets = [[F.col(n)] for n in names]
    grouped = prepared.groupingSets(sets, *names).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("_missing").alias("mean_missing"),
        (F.avg((F.col("_missing") == 0).cast("int")) * 100.0).alias("complete_rows_pct"),
        *[(F.avg(f"_m_{c}") * 100.0).alias(c) for c in columns],
        *[F.grouping(n).alias(f"_g{n}") for n in names],
    )
    dimension = value = None
    for d, n in zip(dims, names):
        active = F.col(f"_g{n}") == 0
        dimension = F.when(active, F.lit(d)) if dimension is None else dimension.when(active, F.lit(d))
        value = F.when(active, F.col(n)) if value is None else value.when(active, F.col(n))
    return grouped.select(
        dimension.alias("dimension"), value.alias("value"), "rows", "mean_missing", "complete_rows_pct", *columns
    ).unpivot(["dimension", "value", "rows", "mean_missing", "complete_rows_pct"], columns, "feature", "missing_pct")


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Normalised frequencies with NULL shown as ``<NA>``."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<NA>")).alias("category")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total), F.lit(True)).select("category", (F.col("_n") / F.col("_all")).alias("share"))


def total_variation(left: DataFrame, right: DataFrame, column: str, name: str = "total_variation") -> DataFrame:
    a = category_share(left, column).withColumnRenamed("share", "_p")
    b = category_share(right, column).withColumnRenamed("share", "_q")
    gap = F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))
    return a.join(b, "category", "full").agg((F.sum(gap) / 2).alias(name))


def distribution_shift(kept: DataFrame, base: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """Moments before and after, tail retention, category shift, tripped limits."""
    shapes = ("mean", "median", "std", "p95", "p99", "max", "skew")
    after = price_distribution(kept, value).select("rows", *[F.col(s).alias(f"after_{s}") for s in shapes])
    before = price_distribution(base, value).select(F.col("rows").alias("base_rows"), *[F.col(s).alias(f"before_{s}") for s in shapes])
    one = after.crossJoin(before)
    edges = F.broadcast(before.select("before_p95", "before_p99"))

    def tails(df: DataFrame, prefix: str) -> DataFrame:
        return df.crossJoin(edges).agg(
            F.count_if(F.col(value) >= F.col("before_p95")).alias(f"{prefix}_top5"),
            F.count_if(F.col(value) >= F.col("before_p99")).alias(f"{prefix}_top1"),
        )

    one = one.crossJoin(tails(kept, "_k")).crossJoin(tails(base, "_b"))
    for c in categories:
        one = one.crossJoin(total_variation(kept, base, c, f"{c}_total_variation"))
    pct = {
        s: F.when(F.col(f"before_{s}") != 0, (F.col(f"after_{s}") - F.col(f"before_{s}")) / F.col(f"before_{s}") * 100.0).otherwise(0.0)
        for s in shapes
    }
    one = one.withColumns({f"{s}_change_pct": c for s, c in pct.items()}).withColumns({
        "retention_pct": F.col("rows") * 100.0 / F.col("base_rows"),
        "top5_retention_pct": F.col("_k_top5") * 100.0 / F.greatest("_b_top5", F.lit(1)),
        "top1_retention_pct": F.col("_k_top1") * 100.0 / F.greatest("_b_top1", F.lit(1)),
    })
    limits = [F.when(F.col("retention_pct") < 90, F.lit("row retention below 90%"))]
    limits += [F.when(F.abs(f"{s}_change_pct") >= 10, F.lit(f"{s} changed by at least 10%")) for s in shapes if s != "skew"]
    limits += [
        F.when(F.col("top5_retention_pct") < 90, F.lit("top-5% retention below 90%")),
        F.when(F.col("top1_retention_pct") < 90, F.lit("top-1% retention below 90%")),
    ]
    limits += [F.when(F.col(f"{c}_total_variation") >= 0.10, F.lit(f"{c} total variation at least 0.10")) for c in categories]
    reasons = F.filter(F.array(*limits), lambda r: r.isNotNull())
    return one.withColumn("shift_reasons", F.array_join(reasons, ";")).withColumn(
        "substantial_shift", (F.size(reasons) > 0).cast("int")
    ).drop("_k_top5", "_k_top1", "_b_top5", "_b_top1")


def frequency_table(df: DataFrame, flags: list[str], minimum: int = 10) -> DataFrame:
    """Hits per indicator with a rarity class; counted in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f) for f in flags])
    n = F.col("count")
    rarity = (
        F.when(n < 3, "extremely rare").when(n < minimum, "rare").when(n < 100, "moderate").otherwise("common")
    )
    return one.unpivot(["_rows"], flags, "feature", "count").select(
        "feature", "count", (n * 100.0 / F.col("_rows")).alias("percentage"),
        rarity.alias("frequency_class"), (n >= minimum).cast("int").alias("modeled"),
    )


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"))


def residual_correlation_matrix(scored: DataFrame, row_id: str, models: list[str]) -> DataFrame:
    """Model by model correlation of residuals, from one pivoted pass."""
    wide = (
        scored.withColumn("_e", F.col("predicted") - F.col("actual")).groupBy(row_id).pivot("model", models).agg(F.first("_e"))
    )
    pairs = [(a, b) for a in models for b in models]
    one = wide.agg(F.array(*[
        F.struct(F.lit(a).alias("model_x"), F.lit(b).alias("model_y"), (F.lit(1.0) if a == b else F.corr(a, b)).alias("correlation"))
        for a, b in pairs
    ]).alias("_p"))
    return one.select(F.explode("_p").alias("p")).select("p.*")


def observed_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Finite minimum and maximum per field."""
    def finite(c: str) -> Column:
        d = F.col(c).cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)

    one = df.agg(F.array(*[
        F.struct(F.lit(c).alias("field"), F.min(finite(c)).alias("minimum"), F.max(finite(c)).alias("maximum")) for c in columns
    ]).alias("_r"))
    return one.select(F.explode("_r").alias("r")).select("r.*")


def distinct_values(df: DataFrame, column: str, default: str = "Unknown") -> DataFrame:
    """Sorted trimmed non-empty values; the default if there are none."""
    text = strip(F.col(column).cast("string"))
    values = df.select(text.alias("value")).where(F.col("value") != "").distinct()
    empty = values.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(default).alias("value"))
    return values.unionByName(empty).orderBy("value")


def physical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing, minimum, maximum and non-integer counts per column."""
    one = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"),
            F.min(F.col(c).cast("double")).alias("minimum"), F.max(F.col(c).cast("double")).alias("maximum"),
            F.count_if(F.col(c).isNotNull() & (F.col(c).cast("double") % 1 != 0)).alias("non_integer"),
        ) for c in columns
    ]).alias("_p"))
    return one.select(F.explode("_p").alias("p")).select("p.*")


def rule_counts(audit: DataFrame, reasons: str = "reasons") -> DataFrame:
    return audit.select(F.explode(reasons).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def histogram(df: DataFrame, value: str, bins: int, by: str) -> DataFrame:
    """Equal-width bins between each group's own minimum and maximum."""
    ranges = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_w"))
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = attach(counted, ranges, [by], "_w")
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.least(F.floor((F.col(value) - F.col("_lo")) / width).cast("int"), F.lit(bins - 1))
    index = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(index)
    return placed.groupBy(by, index.alias("bin")).agg(F.sum("_n").alias("count"))


def hexbin_counts(df: DataFrame, x: str, y: str, gridsize: int) -> DataFrame:
    """Counts in a hexagonal grid: the nearer of two offset lattices wins."""
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    box = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(box), F.lit(True))
    gx = (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * nx
    gy = (F.col(y) - F.col("_y0")) / (F.col("_y1") - F.col("_y0")) * ny
    ax, ay = F.floor(gx + 0.5), F.floor(gy + 0.5)
    bx, by_ = F.floor(gx), F.floor(gy)
    d1 = (gx - ax) * (gx - ax) + 3.0 * (gy - ay) * (gy - ay)
    d2 = (gx - bx - 0.5) * (gx - bx - 0.5) + 3.0 * (gy - by_ - 0.5) * (gy - by_ - 0.5)
    first = d1 < d2
    return placed.groupBy(
        F.when(first, F.lit(0)).otherwise(F.lit(1)).alias("lattice"),
        F.when(first, ax).otherwise(bx).cast("long").alias("hex_x"),
        F.when(first, ay).otherwise(by_).cast("long").alias("hex_y"),
    ).agg(F.count(F.lit(1)).alias("count"))


def ecdf(df: DataFrame, value: str, by: str) -> DataFrame:
    """Empirical distribution steps: share of rows at or below each distinct value."""
    ranked = running_totals(value_counts(df, [by], value), [by], value, "_n")
    return ranked.select(by, value, ((F.col("_before") + F.col("_n")) / F.col("_total")).alias("cumulative_share"))


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles and whiskers: the last values within 1.5 interquartile ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    quarts = quantiles(df, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    sizes = df.groupBy(by).agg(F.count(value).alias("_w"))
    dim = null_safe_join(quarts, sizes, [by])
    placed = attach(counts, dim, [by], "_w")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    low_ok = F.col(value) >= F.col("q1") - fence
    high_ok = F.col(value) <= F.col("q3") + fence
    return placed.groupBy(by).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(low_ok, F.col(value))).alias("whisker_low"), F.max(F.when(high_ok, F.col(value))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~(low_ok & high_ok), F.col("_n"))), F.lit(0)).alias("outliers"),
    )


def letter_values(df: DataFrame, by: str, value: str, depth: int = 4) -> DataFrame:
    """Nested tail quantiles 1/2, 1/4, 1/8 ... in long form."""
    wanted = {}
    for level in range(1, depth + 1):
        tail = 0.5**level
        wanted[f"lower_{level}"] = tail
        wanted[f"upper_{level}"] = 1.0 - tail
    wide = quantiles(df, [by], value, wanted)
    return wide.unpivot([by], list(wanted), "letter", "value")


def kde(df: DataFrame, value: str, by: str, grid_points: int = 50) -> DataFrame:
    """Gaussian density on an even grid over the full range, one curve per group.

    Bandwidth is Scott's rule per group. Equal values are counted first; each
    distinct value then adds one kernel per grid point (a fixed number).
    """
    counts = value_counts(df.select(by, F.col(value).cast("double").alias(value)), [by], value)
    shape = df.groupBy(by).agg(F.count(value).alias("_w"), F.stddev_samp(value).alias("_sd"))
    edges = df.agg(F.min(value).alias("_g0"), F.max(value).alias("_g1"))
    placed = attach(counts, shape, [by], "_w").join(F.broadcast(edges), F.lit(True))
    bandwidth = F.col("_sd") * F.pow(F.col("_w").cast("double"), F.lit(-0.2))
    steps = F.sequence(F.lit(0), F.lit(grid_points - 1))
    long = placed.withColumn("_h", bandwidth).withColumn("grid_index", F.explode(steps))
    at = F.col("_g0") + (F.col("_g1") - F.col("_g0")) * F.col("grid_index") / (grid_points - 1)
    z = (at - F.col(value)) / F.col("_h")
    density = F.sum(F.col("_n") * F.exp(-0.5 * z * z)) / (F.max("_w") * F.max("_h") * ROOT_TWO_PI)
    return long.groupBy(by, "grid_index").agg(F.max(at).alias("grid_value"), density.alias("density"))


def row_missing_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(missing_count(df, columns).alias("missing_fields")).agg(F.count(F.lit(1)).alias("rows"))


def wide_predictions(scored: DataFrame, row_id: str, models: list[str]) -> DataFrame:
    """One row per id with a ``prediction__<model>`` column per model; of repeated predictions the greatest.

    A pivot would shuffle every prediction with its model's name first, and the ids once more.
    """
    return scored.groupBy(row_id).agg(*[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(f"prediction__{m}") for m in models])


def long_predictions(wide: DataFrame, row_id: str, models: list[str]) -> DataFrame:
    plain = wide.withColumnsRenamed({f"prediction__{m}": m for m in models})
    return plain.unpivot([row_id], models, "model", "predicted").where(F.col("predicted").isNotNull())
