"""Imputation and category encoders: fit a table, join it back."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.parse import UNSET, band, combine_keys, ratio
from terrace.operators.filters import training_copies
from terrace.operators.order import null_safe_join, quantiles
from terrace.operators.skew import attach
from terrace.session import compiled_methods, durable, shuffle_width

M_GRID = (5.0, 10.0, 20.0, 50.0, 100.0)


def category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(UNSET))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole-table median in place of missing numbers."""
    result = df
    for c in columns:
        result = result.crossJoin(F.broadcast(quantiles(df, [], c, {f"_med_{c}": 0.5})))
    return result.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in columns}).drop(
        *[f"_med_{c}" for c in columns]
    )


def impute_median_by_fold(df: DataFrame, columns: list[str], folds: int = 5) -> DataFrame:
    """Every row per outer fold, filled with that fold's training medians."""
    copies = df.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    result = copies
    for c in columns:
        medians = quantiles(training_copies(df.select("fold", c), "fold", folds), ["outer_fold"], c, {f"_med_{c}": 0.5})
        result = null_safe_join(result, F.broadcast(medians), ["outer_fold"], "left")
    return result.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in columns}).drop(
        *[f"_med_{c}" for c in columns]
    )


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row with the mode; the smallest value wins a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), column).limit(1).select(F.col(column).alias(f"_mode_{column}"))


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    result = df
    for c in columns:
        result = result.join(F.broadcast(most_frequent(df, c)), F.lit(True), "left")
    return result.withColumns({c: F.coalesce(F.col(c), F.col(f"_mode_{c}")) for c in columns}).drop(
        *[f"_mode_{c}" for c in columns]
    )


def scale_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<col>_scaled`` with population standard deviation, from one aggregate row."""
    stats = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))])
    scaled = {
        f"{c}_scaled": (F.col(c) - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") != 0, F.col(f"_sd_{c}")).otherwise(1.0)
        for c in columns
    }
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"_{s}_{c}" for c in columns for s in ("mu", "sd")])


def standard_scale_stage(column: str, output: str) -> StandardScaler:
    """MLlib stage; it divides by the sample standard deviation."""
    return StandardScaler(inputCol=column, outputCol=output, withMean=True, withStd=True)


def one_hot_stages(columns: list[str]) -> list:
    """Index then encode; an unseen label becomes the all-zero vector."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_ix" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=[f"{c}_ix" for c in columns], outputCols=[f"{c}_oh" for c in columns], dropLast=True, handleInvalid="keep")
    return [index, encode]


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    return Pipeline(stages=one_hot_stages(columns)).fit(df).transform(df)


def assemble(columns: list[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep")


def ordinal_encode(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Alphabetical code per known label; unknown and missing get -1.

    The distinct labels are dealt into ranges and written with the number of
    their range; a code is the place in the range plus the labels before it,
    so no task sorts more than its range whatever the labels look like.
    """
    labels = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    width = shuffle_width(train.sparkSession)
    tagged = durable(labels.repartitionByRange(width, column).withColumn("_bin", F.spark_partition_id()), "labels")
    # At most one row per range.
    ahead = Window.partitionBy(F.lit(1)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select("_bin", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_bin").orderBy(column)
    ranked = tagged.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(offsets), "_bin")
    dim = ranked.select(column, (F.col("_o") + F.col("_r") - 1).cast("int").alias(f"{column}_code"), "_n")
    return attach(rows, dim, [column], "_n").withColumn(
        f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1))
    ).drop("_n")


def fit_target_m(train: DataFrame, column: str, y: str, m: float, keys: list[str] | None = None) -> DataFrame:
    """Smoothed mean per category: ``(n*mean + m*overall) / (n + m)``.

    ``keys`` adds extra grouping columns such as the outer fold. Missing is a
    category of its own.
    """
    keys = keys or []
    sums = train.groupBy(*keys, category(column).alias("category")).agg(F.sum(y).alias("_s"), F.count(y).alias("n"))
    overall = train.groupBy(*keys).agg(F.avg(y).alias("overall"))
    joined = sums.crossJoin(F.broadcast(overall)) if not keys else sums.join(F.broadcast(overall), keys)
    return joined.select(*keys, "category", "n", ((F.col("_s") + m * F.col("overall")) / (F.col("n") + m)).alias("encoded"), "overall")


def apply_target(rows: DataFrame, dim: DataFrame, train_mean: DataFrame, column: str, name: str) -> DataFrame:
    """Encoded value by category; unseen categories get the training mean."""
    tagged = rows.withColumn("_category", category(column))
    joined = attach(tagged, dim.select(F.col("category").alias("_category"), F.col("encoded").alias("_encoded"), F.col("n").alias("_n")), ["_category"], "_n")
    return (
        joined.crossJoin(F.broadcast(train_mean.select(F.col("overall").alias("_overall"))))
        .withColumn(name, F.coalesce("_encoded", "_overall")).drop("_category", "_encoded", "_n", "_overall")
    )


def target_encode_m(train: DataFrame, rows: DataFrame, column: str, y: str, m: float, name: str | None = None) -> DataFrame:
    dim = fit_target_m(train, column, y, m)
    return apply_target(rows, dim, train.agg(F.avg(y).alias("overall")), column, name or f"{column}_te")


def fit_target_auto(train: DataFrame, column: str, y: str) -> DataFrame:
    """Empirical-Bayes shrinkage: the weight grows with n and falls with in-category variance."""
    groups = train.groupBy(category(column).alias("category")).agg(
        F.avg(y).alias("_mean"), F.count(y).alias("n"), F.var_pop(y).alias("_var")
    )
    overall = train.agg(F.avg(y).alias("overall"), F.var_pop(y).alias("_y_var"))
    weight = F.col("_y_var") * F.col("n") / (F.col("_y_var") * F.col("n") + F.col("_var"))
    weight = F.when(F.col("_y_var") == 0, F.lit(0.0)).otherwise(weight)
    return groups.crossJoin(F.broadcast(overall)).select(
        "category", "n", (weight * F.col("_mean") + (1 - weight) * F.col("overall")).alias("encoded"), "overall"
    )


def target_encode_auto(train: DataFrame, rows: DataFrame, column: str, y: str, name: str | None = None) -> DataFrame:
    dim = fit_target_auto(train, column, y)
    return apply_target(rows, dim, train.agg(F.avg(y).alias("overall")), column, name or f"{column}_te")


def _outside_folds(df: DataFrame, keys: list[Column], y: str, fold: str) -> DataFrame:
    """Per key and fold: count, mean and variance of the target in the other folds.

    One aggregate gives a cell per (key, fold); the other folds' cells (at
    most k - 1) are then combined. Nothing is subtracted, so a huge target in
    the own fold leaves no rounding trace either.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    cells = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.col(fold).alias("_f"), F.col(y).alias("_y")).groupBy(*names, "_f").agg(
        F.count("_y").alias("n"), F.coalesce(F.avg("_y"), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop("_y"), F.lit(0.0)).alias("v"),
        F.count(F.lit(1)).alias("rows"),
    )
    listed = cells.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_f", "n", "m", "v", "rows"))).alias("_cells"))
    each = listed.select(*names, "_cells", F.explode("_cells").alias("_own"))
    others = each.select(
        *names, F.col("_own._f").alias("fold"), F.col("_own.rows").alias("_rows"),
        F.filter("_cells", lambda c: c["_f"] != F.col("_own._f")).alias("_others"),
    )
    count = F.aggregate("_others", F.lit(0).cast("long"), lambda t, c: t + c["n"])
    total = F.aggregate("_others", F.lit(0.0), lambda t, c: t + c["n"] * c["m"])
    summed = others.withColumns({"_other_n": count, "_other_sum": total}).withColumn(
        "_other_mean", F.when(F.col("_other_n") > 0, F.col("_other_sum") / F.col("_other_n"))
    )
    spread = F.aggregate(
        "_others", F.lit(0.0), lambda t, c: t + c["n"] * (c["v"] + F.pow(c["m"] - F.coalesce("_other_mean", F.lit(0.0)), F.lit(2.0)))
    )
    return summed.withColumn("_other_var", F.when(F.col("_other_n") > 0, spread / F.col("_other_n"))).drop("_others")


def _fold_remainders(df: DataFrame, column: str, y: str, fold: str) -> DataFrame:
    return _outside_folds(df, [category(column)], y, fold).withColumnRenamed("_key0", "_category")


def _fold_means(df: DataFrame, y: str, fold: str) -> DataFrame:
    """Mean and variance of the target outside each fold."""
    return _outside_folds(df, [F.lit(0)], y, fold).select(
        "fold", F.col("_other_mean").alias("_all_mean"), F.col("_other_var").alias("_all_var")
    )


def target_encode_oof(
    df: DataFrame, column: str, y: str, m: float, fold: str = "fold", name: str | None = None, log_count: str | None = None
) -> DataFrame:
    """Cross-fitted smoothed mean: a row's own fold never enters its value.

    One aggregate per (category, fold) gives all k fits; nothing is refitted.
    """
    cells = _fold_remainders(df, column, y, fold)
    means = _fold_means(df, y, fold)
    encoded = (F.col("_other_sum") + m * F.col("_all_mean")) / (F.col("_other_n") + m)
    dim = cells.join(F.broadcast(means), "fold").select(
        "_category", "fold", "_rows", encoded.alias("_encoded"), F.log1p("_other_n").alias("_log_n")
    )
    tagged = df.withColumn("_category", category(column))
    if fold != "fold":
        dim = dim.withColumnRenamed("fold", fold)
    joined = attach(tagged, dim, ["_category", fold], "_rows").withColumn(name or f"{column}_te", F.col("_encoded"))
    if log_count:
        joined = joined.withColumn(log_count, F.col("_log_n"))
    return joined.drop("_category", "_rows", "_encoded", "_log_n")


def target_encode_auto_oof(df: DataFrame, column: str, y: str, fold: str = "fold", name: str | None = None) -> DataFrame:
    """Cross-fitted empirical-Bayes encoding from the same (category, fold) cells."""
    cells = _fold_remainders(df, column, y, fold)
    joined = cells.join(F.broadcast(_fold_means(df, y, fold)), "fold")
    share = F.col("_all_var") * F.col("_other_n")
    weight = F.when(F.col("_all_var") == 0, F.lit(0.0)).otherwise(share / (share + F.col("_other_var")))
    value = F.when(F.col("_other_n") > 0, weight * F.col("_other_mean") + (1 - weight) * F.col("_all_mean")).otherwise(F.col("_all_mean"))
    dim = joined.select("_category", F.col("fold").alias(fold), "_rows", value.alias("_encoded"))
    tagged = df.withColumn("_category", category(column))
    return attach(tagged, dim, ["_category", fold], "_rows").withColumn(name or f"{column}_te", F.col("_encoded")).drop("_category", "_rows", "_encoded")


def select_m(df: DataFrame, columns: list[str], y: str, grid=M_GRID, fold: str = "fold") -> DataFrame:
    """RMSE of the mean OOF encoding per smoothing value; the best comes first.

    The fold remainders are attached once per column and reused for all m.
    """
    result = df.select(*columns, y, fold)
    for i, c in enumerate(columns):
        dim = _fold_remainders(df.select(c, y, fold), c, y, fold).drop("_other_mean", "_other_var").withColumnsRenamed({"_other_sum": f"_s{i}", "_other_n": f"_n{i}", "_category": f"_c{i}"})
        dim = dim.withColumnRenamed("fold", fold) if fold != "fold" else dim
        tagged = result.withColumn(f"_c{i}", category(c))
        result = attach(tagged, dim, [f"_c{i}", fold], "_rows").drop(f"_c{i}", "_rows")
    means = _fold_means(df, y, fold)
    means = means.withColumnRenamed("fold", fold) if fold != "fold" else means
    result = result.join(F.broadcast(means), fold)
    squares = []
    for m in grid:
        encoded = [(F.col(f"_s{i}") + m * F.col("_all_mean")) / (F.col(f"_n{i}") + m) for i in range(len(columns))]
        error = sum(encoded[1:], encoded[0]) / len(encoded) - F.col(y)
        squares.append(F.struct(F.lit(float(m)).alias("m"), F.sqrt(F.avg(error * error)).alias("rmse")))
    return result.agg(F.array(*squares).alias("_g")).select(F.explode("_g").alias("g")).select("g.*").orderBy("rmse", "m")


def target_encode_with_log_count(train: DataFrame, rows: DataFrame, column: str, y: str, m: float) -> DataFrame:
    dim = fit_target_m(train, column, y, m).select(F.col("category").alias("_category"), F.col("encoded").alias("_encoded"), F.col("n").alias("_n"))
    overall = train.agg(F.avg(y).alias("_overall"))
    joined = attach(rows.withColumn("_category", category(column)), dim, ["_category"], "_n")
    return joined.crossJoin(F.broadcast(overall)).withColumn(
        f"{column}_te", F.coalesce("_encoded", "_overall")
    ).withColumn(f"{column}_log_count", F.log1p(F.coalesce("_n", F.lit(0)))).drop("_category", "_encoded", "_n", "_overall")


def count_encode(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Category frequency and its log; unseen categories count 0."""
    dim = train.groupBy(category(column).alias("_category")).agg(F.count(F.lit(1)).alias("_n"))
    joined = attach(rows.withColumn("_category", category(column)), dim, ["_category"], "_n")
    return joined.withColumn(f"{column}_count", F.coalesce("_n", F.lit(0))).withColumn(
        f"{column}_log_count", F.log1p(f"{column}_count")
    ).drop("_category", "_n")


def context_stats(
    train: DataFrame, rows: DataFrame, place: str, size: str, rooms: tuple[str, ...] = ("bedroom", "bathroom")
) -> DataFrame:
    """Place-level medians, mean and count, plus the ratio to the place median size."""
    keyed = train.withColumn("_category", category(place))
    dim = keyed.groupBy("_category").agg(F.avg(size).alias("place_mean_size"), F.count(F.lit(1)).alias("place_count"))
    overall = train.agg(F.avg(size).alias("_f_place_mean_size"))
    medians = {size: "place_median_size", **{r: f"place_median_{r}" for r in rooms}}
    for column, name in medians.items():
        dim = null_safe_join(dim, quantiles(keyed, ["_category"], column, {name: 0.5}), ["_category"], "left")
        overall = overall.crossJoin(quantiles(train, [], column, {f"_f_{name}": 0.5}))
    joined = attach(rows.withColumn("_category", category(place)), dim, ["_category"], "place_count")
    filled = joined.crossJoin(F.broadcast(overall))
    names = ["place_mean_size", *medians.values()]
    filled = filled.withColumns({n: F.coalesce(F.col(n), F.col(f"_f_{n}")) for n in names})
    filled = filled.withColumn("place_count", F.coalesce("place_count", F.lit(0)))
    return filled.withColumn("ratio_to_place_median_size", ratio(F.col(size), F.col("place_median_size"))).drop(
        "_category", *[f"_f_{n}" for n in names]
    )


# Market levels, their key columns and fallback chains.
MARKET_LEVELS = {
    "state": ("state",),
    "city": ("city",),
    "state_property_type": ("state", "property_type"),
    "city_property_type": ("city", "property_type"),
    "building_name": ("building_name",),
    "developer": ("developer",),
}
MARKET_FALLBACKS = {
    "state": (),
    "city": ("state",),
    "state_property_type": ("state",),
    "city_property_type": ("city", "state_property_type", "state"),
    "building_name": ("city_property_type", "city", "state"),
    "developer": ("city_property_type", "city", "state"),
}
MARKET_STATS = ("median", "mean", "count", "iqr")


def market_table(train: DataFrame, level: str, unit: str, parts: list[str]) -> DataFrame:
    """Unit-price median, mean, count and interquartile range per key of a level."""
    keyed = train.withColumn("_key", combine_keys(*[F.col(c) for c in MARKET_LEVELS[level]]))
    base = keyed.groupBy(*parts, "_key").agg(F.avg(unit).alias("mean"), F.count(unit).alias("count"))
    tails = quantiles(keyed, [*parts, "_key"], unit, {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    return null_safe_join(base, tails, [*parts, "_key"]).select(
        *parts, "_key", "median", "mean", "count", (F.col("_q3") - F.col("_q1")).alias("iqr")
    )


def micro_market_stats(
    train: DataFrame, rows: DataFrame, unit: str, parts: list[str] | None = None, levels: list[str] | None = None
) -> DataFrame:
    """24 market columns per row with fallback chains; counts fall back to 0 only.

    ``parts`` names columns present on both sides (such as ``outer_fold``)
    that separate independent fits.
    """
    parts = parts or []
    needed = list(levels or MARKET_LEVELS)
    fetched = list(dict.fromkeys([x for lv in needed for x in (lv, *MARKET_FALLBACKS[lv])]))
    result = rows
    for level in fetched:
        dim = market_table(train, level, unit, parts).withColumnsRenamed(
            {s: f"_{level}_{s}" for s in MARKET_STATS}
        ).withColumn("_w", F.col(f"_{level}_count"))
        tagged = result.withColumn("_key", combine_keys(*[F.col(c) for c in MARKET_LEVELS[level]]))
        keyed = rows.withColumn("_key", combine_keys(*[F.col(c) for c in MARKET_LEVELS[level]]))
        result = attach(tagged, dim, [*parts, "_key"], "_w", keyed=keyed).drop("_key", "_w")
    base = train.groupBy(*parts).agg(F.avg(unit).alias("_all_mean"))
    tails = quantiles(train, parts, unit, {"_all_median": 0.5, "_all_q1": 0.25, "_all_q3": 0.75})
    overall = null_safe_join(base, tails, parts).withColumn("_all_iqr", F.col("_all_q3") - F.col("_all_q1"))
    result = null_safe_join(result, F.broadcast(overall), parts)
    columns = {}
    for level in needed:
        for stat in MARKET_STATS:
            if stat == "count":
                columns[f"micro_{level}_count"] = F.coalesce(f"_{level}_count", F.lit(0))
            else:
                chain = [F.col(f"_{x}_{stat}") for x in (level, *MARKET_FALLBACKS[level])]
                columns[f"micro_{level}_{stat}"] = F.coalesce(*chain, F.col(f"_all_{stat}"))
    helper = [f"_{lv}_{s}" for lv in fetched for s in MARKET_STATS] + [c for c in overall.columns if c not in parts]
    return result.withColumns(columns).drop(*helper)


def micro_market_oof(df: DataFrame, unit: str, fold: str = "fold", folds: int = 5, levels: list[str] | None = None) -> DataFrame:
    """Market columns from the other folds only.

    Medians cannot be subtracted, so the training side holds each row once per
    fold it trains in; the fits of all folds share one job. Every level reads
    the rows as written once, whatever they were joined from.
    """
    df = durable(df, "market-rows")
    keys = list(dict.fromkeys(c for lv in MARKET_LEVELS.values() for c in lv))
    train = training_copies(df.select(*keys, unit, fold), fold, folds).drop(fold)
    rows = df.withColumn("outer_fold", F.col(fold))
    with compiled_methods(df.sparkSession):
        # Six joins and two dozen chains fused into one method would be interpreted; written here, they are compiled.
        return durable(micro_market_stats(train, rows, unit, ["outer_fold"], levels).drop("outer_fold"), "market-columns")


# Size bands and interaction keys of the engineered schema.
SIZE_EDGES = (600.0, 800.0, 1000.0, 1300.0, 1800.0)
SIZE_LABELS = ("xs", "s", "m", "l", "xl", "xxl")
INTERACTIONS = {
    "state_property_type": ("state", "property_type"),
    "city_property_type": ("city", "property_type"),
    "city_tenure_type": ("city", "tenure_type"),
    "city_building_name": ("city", "building_name"),
    "city_developer": ("city", "developer"),
    "city_size_band": ("city", "size_band"),
    "property_type_size_band": ("property_type", "size_band"),
}
SIZE_FEATURES = ("log1p_property_size_sqft", "property_size_sqft_squared")


def engineered_features(df: DataFrame, edges=SIZE_EDGES, labels=SIZE_LABELS, interactions: bool = True) -> DataFrame:
    size = F.col("property_size_sqft").cast("double")
    result = df.withColumns({
        "log1p_property_size_sqft": F.log1p(size),
        "property_size_sqft_squared": size * size,
        "size_band": band(size, list(edges), list(labels)),
    })
    if interactions:
        result = result.withColumns({n: combine_keys(*[F.col(c) for c in cs]) for n, cs in INTERACTIONS.items()})
    return result


def engineered_schema(
    numeric: list[str], categorical: list[str], drop: tuple[str, ...] = (), interactions: bool = True
) -> tuple[list[str], list[str]]:
    """Feature lists of the engineered table; ``drop`` removes a column and its interactions."""
    keys = [*categorical, "size_band", *(INTERACTIONS if interactions else ())]
    gone = {n for n, cs in INTERACTIONS.items() if set(cs) & set(drop)} | set(drop)
    return [*numeric, *SIZE_FEATURES], [k for k in keys if k not in gone]
