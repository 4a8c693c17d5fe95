"""Error metrics on long prediction tables (actual, predicted, plus keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.order import quantiles, running_totals, with_quantiles
from terrace.operators.stats import PRICE_BANDS, quantile_bands



def error() -> Column:
    return F.col("predicted") - F.col("actual")


def core_metrics() -> list[Column]:
    """Count, RMSE, MAE and R2 in one aggregate."""
    e = error()
    n = F.count(F.lit(1))
    r2 = 1.0 - F.sum(e * e) / (F.var_pop("actual") * n)
    return [
        n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when((n > 1) & (F.var_pop("actual") > 0), r2).alias("r2"),
    ]


def regression_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    base = scored.groupBy(*by).agg(*core_metrics())
    errors = scored.withColumn("_ae", F.abs(error()))
    return with_quantiles(base, errors, by, "_ae", {"median_ae": 0.5})


def adjusted_r2(r2: Column, n: Column, predictors: Column) -> Column:
    """NULL when there are not enough rows for the predictors."""
    return F.when(n > predictors + 1, 1.0 - (1.0 - r2) * (n - 1) / (n - predictors - 1))


def with_adjusted_r2(metrics: DataFrame, predictors: dict[str, int], key: str = "model") -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in predictors.items() for x in pair])
    return metrics.withColumn("adjusted_r2", adjusted_r2(F.col("r2"), F.col("n"), F.try_element_at(table, F.col(key))))


def within_tolerance(scored: DataFrame, by: list[str], tolerance: float = 1000.0) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg((F.abs(error()) < tolerance).cast("int")).alias("within_rate"))


def extended_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """Adds RMSLE (only for all-non-negative groups), percentage and signed errors."""
    a, p, e = F.col("actual"), F.col("predicted"), error()
    usable = (F.min(a) >= 0) & (F.min(p) >= 0)
    log_gap = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(a, F.lit(0.0)))
    base = scored.groupBy(*by).agg(
        *core_metrics(), F.when(usable, F.sqrt(F.avg(log_gap * log_gap))).alias("rmsle"),
        (F.avg(F.abs(e) / a) * 100.0).alias("mape_pct"), F.avg(e).alias("mean_error"),
        F.count_if(p < 0).alias("negative_predictions"), (F.avg((e < 0).cast("int")) * 100.0).alias("underpredicted_pct"),
    )
    prepared = scored.select(*by, F.abs(e).alias("_ae"), (F.abs(e) / a * 100.0).alias("_ape"), e.alias("_e"))
    for column, name in (("_ae", "median_ae"), ("_ape", "median_ape_pct"), ("_e", "median_error")):
        base = with_quantiles(base, prepared, by, column, {name: 0.5})
    return base


def tail_segments(scored: DataFrame, row_id: str = "listing_id") -> DataFrame:
    """Rows repeated for each tail segment they lie in; edges from all actuals.

    Segments overlap: the top 5% contains the other two tail segments. Each row
    id counts once for the edges, whichever models score it.
    """
    actuals = scored.groupBy(row_id).agg(F.max("actual").alias("actual"))
    edges = quantiles(actuals, [], "actual", {"_p95": 0.95, "_p99": 0.99})
    a = F.col("actual")
    names = F.array(
        F.when(a < F.col("_p95"), F.lit("remaining_95")), F.when(a >= F.col("_p95"), F.lit("top_5")),
        F.when((a >= F.col("_p95")) & (a < F.col("_p99")), F.lit("p95_p99")), F.when(a >= F.col("_p99"), F.lit("p99_p100")),
    )
    return scored.crossJoin(F.broadcast(edges)).withColumn(
        "segment", F.explode(F.filter(names, lambda x: x.isNotNull()))
    ).withColumnsRenamed({"_p95": "p95_threshold", "_p99": "p99_threshold"})


def segment_metrics(segmented: DataFrame, by: list[str]) -> DataFrame:
    e = error()
    return segmented.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("mean_error"), (F.avg((e < 0).cast("int")) * 100.0).alias("underpredicted_pct"),
    )


def band_metrics(scored: DataFrame, by: list[str], bands=PRICE_BANDS) -> DataFrame:
    """Metrics per model and price band, with the band's boundaries."""
    labelled = quantile_bands(scored, "actual", bands)
    e = error()
    base = labelled.groupBy(*by, "band").agg(
        F.max("lower_bound").alias("lower_bound"), F.max("upper_bound").alias("upper_bound"),
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("mean_error"),
    )
    return with_quantiles(base, labelled.withColumn("_e", e), [*by, "band"], "_e", {"median_error": 0.5})


def underprediction_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Share and size of shortfalls; 0 where nothing is under-predicted."""
    short = F.col("actual") - F.col("predicted")
    base = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg((short > 0).cast("int")) * 100.0).alias("underpredicted_pct"),
        F.coalesce(F.avg(F.when(short > 0, short)), F.lit(0.0)).alias("mean_shortfall"),
    )
    under = scored.withColumn("_short", short).where("_short > 0")
    return with_quantiles(base, under, by, "_short", {"median_shortfall": 0.5}).withColumn(
        "median_shortfall", F.coalesce("median_shortfall", F.lit(0.0))
    )


def fold_metrics(scored: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """Per model and fold metrics with training and validation row counts."""
    base = scored.groupBy(*by, fold).agg(*core_metrics())
    group = Window.partitionBy(*by)  # one row per fold
    return base.withColumn("training_rows", F.sum("n").over(group) - F.col("n")).withColumnRenamed("n", "validation_rows")


def fold_spread(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.stddev_pop(m).alias(f"{m}_fold_sd") for m in ("rmse", "mae", "r2")])


def repeat_diagnostics(scored: DataFrame, by: list[str], flag: str = "is_grouped_repeat") -> DataFrame:
    """Metrics of repeat and other rows side by side, in one pass."""
    e = error()
    parts = []
    for value, name in ((1, "repeat"), (0, "other")):
        hit = F.col(flag) == value
        parts += [
            F.count_if(hit).alias(f"{name}_n"), F.sqrt(F.avg(F.when(hit, e * e))).alias(f"{name}_rmse"),
            F.avg(F.when(hit, F.abs(e))).alias(f"{name}_mae"),
        ]
    return scored.groupBy(*by).agg(*parts)


def generalization_gap(training: DataFrame, validation: DataFrame, model: str = "model", fold: str = "fold") -> DataFrame:
    """Training metrics averaged over folds against the pooled validation metrics."""
    per_fold = training.groupBy(model, fold).agg(*core_metrics())
    averaged = per_fold.groupBy(model).agg(*[F.avg(m).alias(f"training_{m}") for m in ("rmse", "mae", "r2")])
    pooled = validation.groupBy(model).agg(*core_metrics()).select(model, *[F.col(m).alias(f"cv_{m}") for m in ("rmse", "mae", "r2")])
    joined = averaged.join(pooled, model)
    return joined.withColumns({
        "rmse_gap": F.col("cv_rmse") - F.col("training_rmse"), "mae_gap": F.col("cv_mae") - F.col("training_mae"),
        "r2_gap": F.col("training_r2") - F.col("cv_r2"),
    })


def matched_comparison(original: DataFrame, retrained: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Original and retrained errors on the rows both have, and the original's on the rest."""
    right = retrained.select(*keys, F.col("predicted").alias("_new"))
    joined = original.join(right, keys, "left")
    e, f = error(), F.col("_new") - F.col("actual")
    kept = F.col("_new").isNotNull()
    result = joined.groupBy(*by).agg(
        F.count_if(kept).alias("matched_n"), F.sqrt(F.avg(F.when(kept, e * e))).alias("original_rmse"),
        F.sqrt(F.avg(F.when(kept, f * f))).alias("retrained_rmse"), F.avg(F.when(kept, F.abs(e))).alias("original_mae"),
        F.avg(F.when(kept, F.abs(f))).alias("retrained_mae"), F.count_if(~kept).alias("removed_n"),
        F.sqrt(F.avg(F.when(~kept, e * e))).alias("removed_original_rmse"),
        F.avg(F.when(~kept, F.abs(e))).alias("removed_original_mae"), F.avg(F.when(~kept, F.col("actual"))).alias("removed_mean_actual"),
    )
    return result.withColumn("rmse_gain", F.col("original_rmse") - F.col("retrained_rmse")).withColumn(
        "mae_gain", F.col("original_mae") - F.col("retrained_mae")
    )


def confusion(scores: DataFrame, threshold: float | Column, label: str = "label", score: str = "score") -> list[Column]:
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    return [
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"),
    ]


def classifier_metrics(scores: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts and rates, Brier score, ROC-AUC and step-sum PR-AUC in one row.

    Both areas come from totals per distinct score, so ties and size do not
    matter and nothing is collected.
    """
    y, p = F.col(label).cast("double"), F.col(score)
    base = scores.agg(*confusion(scores, threshold, label, score), F.avg((p - y) * (p - y)).alias("brier"))

    def share(top: Column, bottom: Column, empty=0.0) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    specificity = share(tn, tn + fp, None)
    rates = base.withColumns({
        "precision": precision, "recall": recall, "f1": share(2.0 * tp, 2 * tp + fp + fn),
        "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2.0,
    })
    return rates.crossJoin(area_metrics(scores, label, score))


def area_metrics(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC-AUC (ties count half) and average precision from per-score totals."""
    per = scores.groupBy((-F.col(score)).alias("_neg")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count(F.lit(1)).alias("_all_rows")
    )
    by_rows = running_totals(per, [], "_neg", "_all_rows").withColumnsRenamed({"_before": "_rows_before", "_total": "_rows_total"})
    both = running_totals(by_rows, [], "_neg", "_pos")
    positives, before = F.col("_pos"), F.col("_before")
    negatives = F.col("_all_rows") - positives
    neg_total = F.col("_rows_total") - F.col("_total")
    roc = F.sum(negatives * (before + positives / 2.0)) / F.max(F.col("_total") * neg_total)
    precision = (before + positives) / (F.col("_rows_before") + F.col("_all_rows"))
    return both.agg(roc.alias("roc_auc"), F.sum(positives / F.col("_total") * precision).alias("pr_auc"))


def routing_error_impact(scored: DataFrame, truth: str, routed: str) -> DataFrame:
    """Metrics by routing outcome; an empty outcome keeps a row with 0."""
    t, r = F.col(truth) == 1, F.col(routed) == 1
    label = F.when(t & r, "TP").when(t & ~r, "FN").when(~t & r, "FP").otherwise("TN")
    labelled = scored.withColumn("routing_group", label).withColumn("_e", error())
    base = labelled.groupBy("routing_group").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("mean_error"),
    )
    full = with_quantiles(base, labelled, ["routing_group"], "_e", {"median_error": 0.5})
    dim = scored.sparkSession.createDataFrame([("TP",), ("FN",), ("FP",), ("TN",)], "routing_group string")
    return F.broadcast(dim).join(full, "routing_group", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def quantile_diagnostics(predictions: DataFrame, quantile_columns: dict[str, float] | None = None) -> DataFrame:
    """Pinball losses, P10-P90 coverage and width, and crossing counts in one row."""
    columns = quantile_columns or {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    a = F.col("actual")
    losses = [
        F.avg(F.greatest(F.lit(q) * (a - F.col(c)), F.lit(q - 1.0) * (a - F.col(c)))).alias(f"{c}_pinball") for c, q in columns.items()
    ]
    low, mid, high = (F.col(c) for c in columns)
    return predictions.agg(
        *losses, (F.avg(a.between(low, high).cast("int")) * 100.0).alias("coverage_pct"), F.avg(high - low).alias("mean_width"),
        F.count_if(low > mid).alias("low_above_mid"), F.count_if(mid > high).alias("mid_above_high"),
    )


def stability(metrics: DataFrame, model: str, scenario: str, columns: list[str]) -> DataFrame:
    """Each metric per scenario A, B, C with the three differences."""
    aggregates = [F.max(F.when(F.col(scenario) == s, F.col(m))).alias(f"{m}_{s}") for m in columns for s in "ABC"]
    wide = metrics.groupBy(model).agg(*aggregates)
    deltas = {f"{m}_{x}_minus_{y}": F.col(f"{m}_{x}") - F.col(f"{m}_{y}") for m in columns for x, y in (("B", "A"), ("C", "B"), ("C", "A"))}
    return wide.withColumns(deltas)


def rankings(metrics: DataFrame, scenario: str, model: str) -> DataFrame:
    """Models ordered by RMSE and by MAE per scenario, and whether both agree on the best.

    Input is a report: one row per scenario and model.
    """
    def ordered(metric: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct(F.col(metric).alias("k"), F.col(model).alias("m"))))
        return F.transform(pairs, lambda x: x["m"])

    result = metrics.groupBy(scenario).agg(ordered("rmse").alias("_r"), ordered("mae").alias("_a"))
    return result.select(
        scenario, F.array_join("_r", ">").alias("rmse_order"), F.array_join("_a", ">").alias("mae_order"),
        F.get("_r", F.lit(0)).alias("best_rmse"), F.get("_a", F.lit(0)).alias("best_mae"),
        (F.get("_r", F.lit(0)) == F.get("_a", F.lit(0))).cast("int").alias("best_by_both"),
    )


def adoption_gate(candidates: DataFrame, rules: dict[str, Column], order: list[Column], row_id: str, baseline: str) -> DataFrame:
    """Named checks per candidate, the failed ones, and the chosen candidate.

    The first passing candidate in ``order`` is chosen, else the baseline.
    """
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    judged = candidates.withColumn("_failed", failed).withColumn("passed", (F.size("_failed") == 0).cast("int"))
    chosen = judged.where("passed = 1").orderBy(*order, row_id).limit(1).select(F.col(row_id).alias("_chosen"))
    fallback = candidates.sparkSession.createDataFrame([(baseline,)], "_base string")
    pick = fallback.join(chosen, F.lit(True), "left").select(F.coalesce("_chosen", "_base").alias("adopted"))
    return judged.crossJoin(F.broadcast(pick)).withColumn("failed_checks", F.array_join("_failed", ";")).drop("_failed")


def trim_rules() -> dict[str, Column]:
    """Upper-tail trimming: clear gains, enough fold wins, no tail damage."""
    c = F.col
    return {
        "improves_rmse": c("rmse_change") < 0, "improves_mae": c("mae_change") < 0,
        "rmse_interval_below_zero": c("rmse_ci_upper") < 0, "mae_interval_below_zero": c("mae_ci_upper") < 0,
        "rmse_fold_wins": c("rmse_fold_wins") >= 3, "mae_fold_wins": c("mae_fold_wins") >= 3,
        "top5_not_worse": c("top5_rmse_change") <= 0, "top1_not_worse": c("top1_rmse_change") <= 0,
    }


def winsor_rules(with_adjusted: bool = False) -> dict[str, Column]:
    c = F.col
    rules = {
        "improves_rmse": c("rmse_change") < 0, "mae_within_half_percent": c("mae_change_pct") <= 0.5,
        "r2_not_worse": c("r2_change") >= 0, "top5_rmse_within_5_percent": c("top5_rmse_change_pct") <= 5.0,
        "top5_mae_within_5_percent": c("top5_mae_change_pct") <= 5.0,
    }
    if with_adjusted:
        rules["adjusted_r2_not_worse"] = c("adjusted_r2_change") >= 0
    return rules


def log_target_rules() -> dict[str, Column]:
    rules = winsor_rules()
    rules["mean_bias_within_2_percent"] = F.abs(F.col("mean_error")) <= 0.02 * F.col("mean_actual")
    return rules


def promotion_rules() -> dict[str, Column]:
    c = F.col
    return {
        "rmse_gain_1_percent": c("rmse_change_pct") <= -1.0, "mae_within_half_percent": c("mae_change_pct") <= 0.5,
        "r2_stable": c("r2_change") >= -0.001, "top5_rmse_within_5_percent": c("top5_rmse_change_pct") <= 5.0,
        "mean_bias_below_2_percent": F.abs("mean_error") <= 0.02 * c("mean_actual"),
        "r2_gap_within_0_05": c("r2_gap") <= c("baseline_r2_gap") + 0.05, "rmse_interval_below_zero": c("rmse_ci_upper") < 0,
    }


def scope_metrics(scored: DataFrame, cap: float, by: list[str]) -> DataFrame:
    """Metrics of rows at or below a price cap."""
    return scored.where(F.col("actual") <= cap).groupBy(*by).agg(*core_metrics())


def prediction_points(scored: DataFrame, model: str, cap: float | None = None) -> DataFrame:
    """Actual-against-predicted points of one model and scope, finite and positive only."""
    rows = scored.where(F.col("model") == model)
    if cap is not None:
        rows = rows.where(F.col("actual") <= cap)
    finite = ~F.isnan("predicted") & (F.abs("predicted") != F.lit(float("inf"))) & (F.col("actual") > 0)
    return rows.where(finite).withColumn("error", error())


def report_long(report: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Report metrics as (keys, metric, value) series."""
    doubles = report.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(keys, metrics, "metric", "value")


def before_after(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Two reports side by side with absolute and percent change."""
    a = before.select(key, *[F.col(m).alias(f"before_{m}") for m in metrics])
    b = after.select(key, *[F.col(m).alias(f"after_{m}") for m in metrics])
    joined = a.join(b, key)
    changes = {}
    for m in metrics:
        changes[f"{m}_change"] = F.col(f"after_{m}") - F.col(f"before_{m}")
        changes[f"{m}_change_pct"] = (F.col(f"after_{m}") - F.col(f"before_{m}")) / F.col(f"before_{m}") * 100.0
    return joined.withColumns(changes)
