"""Encoders, evaluation, quality checks, audit, geo and round-trip queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.numeric import haversine_km, to_target
from terrace.operators import audit, bootstrap, encode, evaluate, geo, models, quality, stats
from terrace.operators.order import quantiles
from terrace.plans.cleaning_queries import CORE, KEY, RAW, raw, raw_sql, numbered, NUMBERED
from terrace.plans.registry import query, rounded, sql_fold, with_listings, with_scored
from terrace.plans.report_queries import COPIES, FOLDED, METRICS, REPORT, report, with_folds
from terrace.session import durable, shared_folder
from terrace.sources import tables
from terrace.sources.surrogate import MODELS, listings, scored, table

# --- encoders --------------------------------------------------------------


@query("encode_impute_median", with_listings(
    " SELECT listing_id, round(coalesce(completion_year, (SELECT quantile_cont(completion_year::DOUBLE, 0.5) FROM listings)), 4) AS completion_year, round(coalesce(number_of_floors, (SELECT quantile_cont(number_of_floors::DOUBLE, 0.5) FROM listings)), 4) AS number_of_floors FROM listings"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "completion_year", "number_of_floors"])
    return rounded(encode.impute_median(df, ["completion_year", "number_of_floors"]))


@query("encode_impute_median_by_fold", with_listings(
    FOLDED + COPIES + ", m AS (SELECT outer_fold, quantile_cont(total_units::DOUBLE, 0.5) AS med FROM t GROUP BY 1) SELECT listing_id, CAST(outer_fold AS INTEGER) AS outer_fold, round(coalesce(total_units, med), 4) AS total_units FROM f CROSS JOIN m"))
def _(spark, sf):
    out = encode.impute_median_by_fold(with_folds(spark, sf, "total_units"), ["total_units"])
    return rounded(out.select("listing_id", "outer_fold", "total_units"))


@query("encode_impute_mode", with_listings(", c AS (SELECT developer, count(*) AS n FROM listings WHERE developer IS NOT NULL GROUP BY 1) SELECT listing_id, coalesce(developer, (SELECT developer FROM c ORDER BY n DESC, developer LIMIT 1)) AS developer FROM listings"))
def _(spark, sf):
    return encode.impute_mode(listings(spark, sf, ["listing_id", "developer"]), ["developer"])


@query("encode_scale", with_listings(" SELECT listing_id, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price_scaled FROM listings"))
def _(spark, sf):
    return rounded(encode.scale_columns(listings(spark, sf, ["listing_id", "price"]), ["price"]).select("listing_id", "price_scaled"), 6)


@query("encode_one_hot", with_listings(
    ", k AS (SELECT DISTINCT state FROM listings), c AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS code FROM k) SELECT listing_id, CAST(code AS INTEGER) AS active_index FROM listings JOIN c USING (state)"))
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    out = encode.one_hot(listings(spark, sf, ["listing_id", "state"]), ["state"])
    return out.select("listing_id", (F.array_position(vector_to_array("state_oh"), F.lit(1.0)) - 1).cast("int").alias("active_index"))


@query("encode_ordinal", with_listings(
    ", k AS (SELECT DISTINCT building_name FROM listings WHERE price > 100000), c AS (SELECT building_name, row_number() OVER (ORDER BY building_name) - 1 AS code FROM k) SELECT listing_id, CAST(coalesce(code, -1) AS INTEGER) AS building_name_code FROM listings LEFT JOIN c USING (building_name)"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "building_name", "price"])
    return encode.ordinal_encode(df.where("price > 100000"), df, "building_name").select("listing_id", "building_name_code")


@query("encode_target_m", with_listings(
    ", t AS (SELECT coalesce(developer, '__MISSING__') AS k, unit_price FROM listings WHERE price > 60000), g AS (SELECT avg(unit_price) AS a FROM t), d AS (SELECT k, (sum(unit_price) + 20 * (SELECT a FROM g)) / (count(*) + 20) AS v FROM t GROUP BY 1)"
    " SELECT listing_id, round(coalesce(v, (SELECT a FROM g)), 4) AS developer_te FROM listings LEFT JOIN d ON coalesce(developer, '__MISSING__') = k"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "developer", "unit_price", "price"])
    return rounded(encode.target_encode_m(df.where("price > 60000"), df, "developer", "unit_price", 20.0).select("listing_id", "developer_te"))


@query("encode_target_auto", with_listings(
    ", g AS (SELECT avg(unit_price) AS a, var_pop(unit_price) AS vy FROM listings), c AS (SELECT coalesce(developer, '__MISSING__') AS k, avg(unit_price) AS m, count(*) AS n, var_pop(unit_price) AS vc FROM listings GROUP BY 1), d AS (SELECT k, vy * n / (vy * n + vc) * m + (1 - vy * n / (vy * n + vc)) * a AS v FROM c, g)"
    " SELECT listing_id, round(v, 4) AS developer_te FROM listings LEFT JOIN d ON coalesce(developer, '__MISSING__') = k"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "developer", "unit_price"])
    return rounded(encode.target_encode_auto(df, df, "developer", "unit_price").select("listing_id", "developer_te"))


@query("encode_target_auto_oof", with_listings(
    FOLDED + ", p AS (SELECT DISTINCT coalesce(developer, '__MISSING__') AS k, gfold FROM f), g AS (SELECT o.k AS gfold, avg(unit_price) AS a, var_pop(unit_price) AS vy FROM f JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) o ON f.gfold <> o.k GROUP BY 1),"
    " c AS (SELECT p.k, p.gfold, avg(unit_price) AS m, count(unit_price) AS n, var_pop(unit_price) AS vc FROM p LEFT JOIN f ON coalesce(f.developer, '__MISSING__') = p.k AND f.gfold <> p.gfold GROUP BY 1, 2),"
    " d AS (SELECT k, gfold, CASE WHEN n > 0 THEN vy * n / (vy * n + vc) * m + (1 - vy * n / (vy * n + vc)) * a ELSE a END AS v FROM c JOIN g USING (gfold)) SELECT listing_id, round(v, 4) AS developer_te FROM f JOIN d ON coalesce(developer, '__MISSING__') = k AND f.gfold = d.gfold"))
def _(spark, sf):
    return rounded(encode.target_encode_auto_oof(with_folds(spark, sf, "developer", "unit_price"), "developer", "unit_price").select("listing_id", "developer_te"))


OOF_CELLS = (FOLDED + ", g AS (SELECT o.k AS gfold, avg(unit_price) AS a FROM f JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) o ON f.gfold <> o.k GROUP BY 1),"
             " s AS (SELECT coalesce(developer, '__MISSING__') AS k, gfold, sum(unit_price) AS s, count(*) AS n FROM f GROUP BY 1, 2),"
             " r AS (SELECT k, gfold, sum(s) OVER (PARTITION BY k) - s AS os, sum(n) OVER (PARTITION BY k) - n AS onn FROM s)")


@query("encode_target_oof", with_listings(
    OOF_CELLS + " SELECT listing_id, round((os + 20 * a) / (onn + 20), 4) AS developer_te, round(ln(1 + onn), 6) AS developer_log_count FROM f JOIN r ON coalesce(developer, '__MISSING__') = k AND f.gfold = r.gfold JOIN g ON g.gfold = f.gfold"))
def _(spark, sf):
    out = encode.target_encode_oof(with_folds(spark, sf, "developer", "unit_price"), "developer", "unit_price", 20.0, log_count="developer_log_count")
    return out.select("listing_id", F.round("developer_te", 4).alias("developer_te"), F.round("developer_log_count", 6).alias("developer_log_count"))


@query("encode_select_m", with_listings(
    OOF_CELLS + ", m AS (SELECT unnest([5.0, 10.0, 20.0, 50.0, 100.0])::DOUBLE AS m) SELECT m, round(sqrt(avg(pow((os + m * a) / (onn + m) - unit_price, 2))), 4) AS rmse FROM f JOIN r ON coalesce(developer, '__MISSING__') = k AND f.gfold = r.gfold JOIN g ON g.gfold = f.gfold CROSS JOIN m GROUP BY 1"))
def _(spark, sf):
    return rounded(encode.select_m(with_folds(spark, sf, "developer", "unit_price"), ["developer"], "unit_price"))


@query("encode_counts", with_listings(
    ", c AS (SELECT coalesce(developer, '__MISSING__') AS k, count(*) AS n, (sum(unit_price) + 10 * (SELECT avg(unit_price) FROM listings WHERE price > 90000)) / (count(*) + 10) AS v FROM listings WHERE price > 90000 GROUP BY 1)"
    " SELECT listing_id, coalesce(n, 0) AS developer_count, round(ln(1 + coalesce(n, 0)), 6) AS developer_log_count, round(coalesce(v, (SELECT avg(unit_price) FROM listings WHERE price > 90000)), 4) AS developer_te FROM listings LEFT JOIN c ON coalesce(developer, '__MISSING__') = k"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "developer", "unit_price", "price"])
    train = df.where("price > 90000")
    counted = encode.count_encode(train, df, "developer").drop("developer_log_count")
    both = encode.target_encode_with_log_count(train, counted, "developer", "unit_price", 10.0)
    return both.select("listing_id", "developer_count", F.round("developer_log_count", 6).alias("developer_log_count"), F.round("developer_te", 4).alias("developer_te"))


@query("encode_context", with_listings(
    ", t AS (SELECT * FROM listings WHERE state <> 'ASIA'), c AS (SELECT city, avg(property_size_sqft) AS ms, count(*) AS n, quantile_cont(property_size_sqft, 0.5) AS md, quantile_cont(bedroom::DOUBLE, 0.5) AS mb, quantile_cont(bathroom::DOUBLE, 0.5) AS mh FROM t GROUP BY 1),"
    " g AS (SELECT avg(property_size_sqft) AS ms, quantile_cont(property_size_sqft, 0.5) AS md, quantile_cont(bedroom::DOUBLE, 0.5) AS mb, quantile_cont(bathroom::DOUBLE, 0.5) AS mh FROM t)"
    " SELECT listing_id, round(coalesce(c.ms, g.ms), 6) AS place_mean_size, coalesce(n, 0) AS place_count, round(coalesce(c.md, g.md), 4) AS place_median_size, round(coalesce(c.mb, g.mb), 4) AS place_median_bedroom, round(coalesce(c.mh, g.mh), 4) AS place_median_bathroom, round(property_size_sqft / coalesce(c.md, g.md), 6) AS ratio_to_place_median_size FROM listings LEFT JOIN c USING (city) CROSS JOIN g"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "city", "state", "property_size_sqft", "bedroom", "bathroom"])
    out = encode.context_stats(df.where("state <> 'ASIA'"), df, "city", "property_size_sqft").drop("city", "state", "property_size_sqft", "bedroom", "bathroom")
    return rounded(out, 6)


MARKET_KEYS = {"state": "state", "city": "city", "state_property_type": "state || '__' || property_type", "city_property_type": "city || '__' || property_type",
               "building_name": "building_name", "developer": "coalesce(developer, '__MISSING__')"}


def market_sql(train: str, rows: str, part: str, prefix: str) -> str:
    """Oracle of the market columns; ``part`` is a join condition tail per level."""
    tables_, joins_, columns = [], [], []
    fields = "avg(unit_price) AS mean, count(*) AS count, quantile_cont(unit_price, 0.5) AS median, quantile_cont(unit_price, 0.75) - quantile_cont(unit_price, 0.25) AS iqr"
    pk = "outer_fold, " if part else ""
    pg = "GROUP BY outer_fold, k" if part else "GROUP BY k"
    for lv, key in MARKET_KEYS.items():
        tables_.append(f"m_{lv} AS (SELECT {pk}{key} AS k, {fields} FROM {train} {pg})")
        joins_.append(f"LEFT JOIN m_{lv} ON m_{lv}.k = {key}" + (f" AND m_{lv}.outer_fold = x.gfold" if part else ""))
    tables_.append(f"m_all AS (SELECT {pk}{fields} FROM {train}" + (" GROUP BY outer_fold)" if part else ")"))
    joins_.append("JOIN m_all ON m_all.outer_fold = x.gfold" if part else "CROSS JOIN m_all")
    for lv in MARKET_KEYS:
        columns.append(f"coalesce(m_{lv}.count, 0) AS micro_{lv}_count")
        for s in ("median", "mean", "iqr"):
            chain = ", ".join(f"m_{x}.{s}" for x in (lv, *encode.MARKET_FALLBACKS[lv]))
            columns.append(f"round(coalesce({chain}, m_all.{s}), {4 if s == 'mean' else 9}) AS micro_{lv}_{s}")
    return prefix + ", " + ", ".join(tables_) + f" SELECT listing_id, {', '.join(columns)} FROM {rows} x {' '.join(joins_)}"


def market_rounded(df: DataFrame) -> DataFrame:
    return df.select("listing_id", *[
        F.round(c, 4 if c.endswith("_mean") else 9).alias(c) if not c.endswith("_count") else F.col(c) for c in df.columns if c.startswith("micro_")])


MARKET_COLUMNS = ["state", "city", "property_type", "building_name", "developer", "unit_price"]


@query("encode_micro_market", with_listings(market_sql("t", "listings", "", ", t AS (SELECT * FROM listings WHERE state <> 'ASIA' AND bedroom < 4)")))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "bedroom", *MARKET_COLUMNS])
    return market_rounded(encode.micro_market_stats(df.where("state <> 'ASIA' AND bedroom < 4"), df, "unit_price"))


@query("encode_micro_market_oof", with_listings(market_sql("t", "f", "fold", FOLDED + COPIES)))
def _(spark, sf):
    return market_rounded(encode.micro_market_oof(with_folds(spark, sf, *MARKET_COLUMNS), "unit_price"))


# --- evaluation ------------------------------------------------------------

R4 = "round({c}, 4) AS {c}"


@query("eval_regression_metrics", with_scored(f", m AS (SELECT state, model, {METRICS}, quantile_cont(abs(predicted - actual), 0.5) AS median_ae FROM scored GROUP BY 1, 2) SELECT state, model, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, round(median_ae, 4) AS median_ae FROM m"))
def _(spark, sf):
    out = evaluate.regression_metrics(scored(spark, sf, ["state"]), ["state", "model"])
    return rounded(out.withColumn("r2", F.round("r2", 6)).withColumns({c: F.round(c, 4) for c in ("rmse", "mae", "median_ae")}), 6)


PREDICTORS = {"model_a": 32, "model_b": 42, "model_c": 47, "model_d": 60000}


@query("eval_adjusted_r2", with_scored(REPORT + " SELECT model, round(CASE WHEN n > p + 1 THEN 1 - (1 - r2) * (n - 1) / (n - p - 1) END, 6) AS adjusted_r2 FROM report JOIN (VALUES ('model_a', 32), ('model_b', 42), ('model_c', 47), ('model_d', 60000)) v(model, p) USING (model)"))
def _(spark, sf):
    return rounded(evaluate.with_adjusted_r2(report(spark, sf, "model"), PREDICTORS).select("model", "adjusted_r2"), 6)


@query("eval_within_tolerance", with_scored("SELECT model, round(avg((abs(predicted - actual) < 1000)::INT), 6) AS within_rate FROM scored GROUP BY 1"))
def _(spark, sf):
    return rounded(evaluate.within_tolerance(scored(spark, sf), ["model"]), 6)


@query("eval_extended", with_scored(
    "SELECT model, round(sqrt(avg(pow(ln(1 + predicted) - ln(1 + actual), 2))), 6) AS rmsle, round(avg(abs(predicted - actual) / actual) * 100, 4) AS mape_pct, round(quantile_cont(abs(predicted - actual) / actual * 100, 0.5), 4) AS median_ape_pct, round(avg(predicted - actual), 4) AS mean_error,"
    " round(quantile_cont(predicted - actual, 0.5), 4) AS median_error, count(*) FILTER (WHERE predicted < 0) AS negative_predictions, round(avg((predicted < actual)::INT) * 100, 4) AS underpredicted_pct FROM scored GROUP BY 1"))
def _(spark, sf):
    out = evaluate.extended_metrics(scored(spark, sf), ["model"])
    names = ("mape_pct", "median_ape_pct", "mean_error", "median_error", "underpredicted_pct")
    return out.select("model", F.round("rmsle", 6).alias("rmsle"), "negative_predictions", *[F.round(c, 4).alias(c) for c in names])


SEGMENTS = ", q AS (SELECT quantile_cont(price, 0.95) AS p95, quantile_cont(price, 0.99) AS p99 FROM listings), seg AS (SELECT s.*, unnest(list_filter([CASE WHEN actual < p95 THEN 'remaining_95' END, CASE WHEN actual >= p95 THEN 'top_5' END, CASE WHEN actual >= p95 AND actual < p99 THEN 'p95_p99' END, CASE WHEN actual >= p99 THEN 'p99_p100' END], lambda x: x IS NOT NULL)) AS segment FROM scored s, q)"


@query("eval_tail_segments", with_scored(SEGMENTS + " SELECT model, segment, count(*) AS n, round(sqrt(avg(pow(predicted - actual, 2))), 4) AS rmse, round(avg(abs(predicted - actual)), 4) AS mae, round(avg(predicted - actual), 4) AS mean_error, round(avg((predicted < actual)::INT) * 100, 4) AS underpredicted_pct FROM seg GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(evaluate.segment_metrics(evaluate.tail_segments(scored(spark, sf)), ["model", "segment"]))


@query("eval_band_metrics", with_scored(
    ", q AS (SELECT min(actual) AS a, quantile_cont(actual, 0.95) AS b, quantile_cont(actual, 0.99) AS c, max(actual) AS d FROM scored), l AS (SELECT *, CASE WHEN actual < b THEN 'P00_P95' WHEN actual < c THEN 'P95_P99' ELSE 'P99_P100' END AS band, CASE WHEN actual < b THEN a WHEN actual < c THEN b ELSE c END AS lo, CASE WHEN actual < b THEN b WHEN actual < c THEN c ELSE d END AS hi FROM scored, q)"
    " SELECT model, band, round(max(lo), 4) AS lower_bound, round(max(hi), 4) AS upper_bound, count(*) AS n, round(sqrt(avg(pow(predicted - actual, 2))), 4) AS rmse, round(avg(abs(predicted - actual)), 4) AS mae, round(avg(predicted - actual), 4) AS mean_error, round(quantile_cont(predicted - actual, 0.5), 4) AS median_error FROM l GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(evaluate.band_metrics(scored(spark, sf), ["model"]))


@query("eval_underprediction", with_scored("SELECT model, count(*) AS n, round(avg((predicted < actual)::INT) * 100, 4) AS underpredicted_pct, round(avg(actual - predicted) FILTER (WHERE predicted < actual), 4) AS mean_shortfall, round(quantile_cont(actual - predicted, 0.5) FILTER (WHERE predicted < actual), 4) AS median_shortfall FROM scored GROUP BY 1"))
def _(spark, sf):
    return rounded(evaluate.underprediction_summary(scored(spark, sf), ["model"]))


@query("eval_fold_metrics", with_scored(REPORT + " SELECT model, fold, n AS validation_rows, CAST(sum(n) OVER (PARTITION BY model) - n AS BIGINT) AS training_rows, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2 FROM by_fold"))
def _(spark, sf):
    out = evaluate.fold_metrics(scored(spark, sf), ["model"])
    return out.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "r2": F.round("r2", 6)})


@query("eval_fold_spread", with_scored(REPORT + " SELECT model, round(stddev_pop(rmse), 4) AS rmse_fold_sd, round(stddev_pop(mae), 4) AS mae_fold_sd, round(stddev_pop(r2), 6) AS r2_fold_sd FROM by_fold GROUP BY 1"))
def _(spark, sf):
    out = evaluate.fold_spread(evaluate.fold_metrics(scored(spark, sf), ["model"]), ["model"])
    return out.select("model", F.round("rmse_fold_sd", 4).alias("rmse_fold_sd"), F.round("mae_fold_sd", 4).alias("mae_fold_sd"), F.round("r2_fold_sd", 6).alias("r2_fold_sd"))


@query("eval_repeat_diagnostics", with_scored(
    "SELECT model, count(*) FILTER (WHERE bedroom = 1) AS repeat_n, round(sqrt(avg(pow(predicted - actual, 2)) FILTER (WHERE bedroom = 1)), 4) AS repeat_rmse, round(avg(abs(predicted - actual)) FILTER (WHERE bedroom = 1), 4) AS repeat_mae,"
    " count(*) FILTER (WHERE bedroom <> 1) AS other_n, round(sqrt(avg(pow(predicted - actual, 2)) FILTER (WHERE bedroom <> 1)), 4) AS other_rmse, round(avg(abs(predicted - actual)) FILTER (WHERE bedroom <> 1), 4) AS other_mae FROM scored GROUP BY 1"))
def _(spark, sf):
    df = scored(spark, sf, ["bedroom"]).withColumn("is_grouped_repeat", (F.col("bedroom") == 1).cast("int"))
    return rounded(evaluate.repeat_diagnostics(df, ["model"]))


@query("eval_generalization_gap", with_scored(
    f", tr AS (SELECT model, o.k AS of, actual, actual + (predicted - actual) * 0.5 AS predicted FROM scored JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) o ON fold <> o.k), a AS (SELECT model, of, {METRICS} FROM tr GROUP BY 1, 2), b AS (SELECT model, avg(rmse) AS t1, avg(mae) AS t2, avg(r2) AS t3 FROM a GROUP BY 1), c AS (SELECT model, {METRICS} FROM scored GROUP BY 1)"
    " SELECT model, round(t1, 4) AS training_rmse, round(t2, 4) AS training_mae, round(t3, 4) AS training_r2, round(rmse, 4) AS cv_rmse, round(mae, 4) AS cv_mae, round(r2, 4) AS cv_r2, round(rmse - t1, 4) AS rmse_gap, round(mae - t2, 4) AS mae_gap, round(t3 - r2, 4) AS r2_gap FROM b JOIN c USING (model)"))
def _(spark, sf):
    from terrace.operators.filters import training_copies

    df = scored(spark, sf)
    train = training_copies(df).withColumn("predicted", F.col("actual") + (F.col("predicted") - F.col("actual")) * 0.5).drop("fold").withColumnRenamed("outer_fold", "fold")
    return rounded(evaluate.generalization_gap(train, df))


MATCHED = ("SELECT model, count(*) FILTER (WHERE kept) AS matched_n, round(sqrt(avg(e * e) FILTER (WHERE kept)), 4) AS original_rmse, round(sqrt(avg(g * g) FILTER (WHERE kept)), 4) AS retrained_rmse, round(avg(abs(e)) FILTER (WHERE kept), 4) AS original_mae, round(avg(abs(g)) FILTER (WHERE kept), 4) AS retrained_mae,"
           " count(*) FILTER (WHERE NOT kept) AS removed_n, round(sqrt(avg(e * e) FILTER (WHERE NOT kept)), 4) AS removed_original_rmse, round(avg(abs(e)) FILTER (WHERE NOT kept), 4) AS removed_original_mae, round(avg(actual) FILTER (WHERE NOT kept), 4) AS removed_mean_actual,"
           " round(sqrt(avg(e * e) FILTER (WHERE kept)) - sqrt(avg(g * g) FILTER (WHERE kept)), 4) AS rmse_gain, round(avg(abs(e)) FILTER (WHERE kept) - avg(abs(g)) FILTER (WHERE kept), 4) AS mae_gain FROM x GROUP BY 1")


@query("eval_matched_comparison", with_scored(", x AS (SELECT model, actual, predicted - actual AS e, (predicted - actual) * 0.9 AS g, actual <= 80000 AS kept FROM scored) " + MATCHED))
def _(spark, sf):
    df = scored(spark, sf)
    again = df.where("actual <= 80000").withColumn("predicted", F.col("actual") + (F.col("predicted") - F.col("actual")) * 0.9)
    return rounded(evaluate.matched_comparison(df, again, ["model", "listing_id"], ["model"]))


@query("eval_bootstrap_points", with_scored(
    ", w AS (SELECT listing_id, max(actual) AS a, " + ", ".join(f"max(predicted) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS) + " FROM scored GROUP BY 1), q AS (SELECT quantile_cont(price, 0.95) AS p95 FROM listings), l AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS reference_model, a, model_a AS c, {m} AS r, a >= p95 AS tail FROM w, q" for m in MODELS[1:])
    + ") SELECT reference_model, round(sqrt(avg(pow(c - a, 2))) - sqrt(avg(pow(r - a, 2))), 4) AS rmse_difference, round(avg(abs(c - a) - abs(r - a)), 4) AS mae_difference, round(sqrt(avg(pow(c - a, 2)) FILTER (WHERE tail)) - sqrt(avg(pow(r - a, 2)) FILTER (WHERE tail)), 4) AS tail_difference FROM l GROUP BY 1"))
def _(spark, sf):
    return rounded(bootstrap.paired_difference(model_pairs(spark, sf), ["reference_model"]))


def model_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = bootstrap.pair_models(scored(spark, sf), "listing_id", "model_a", list(MODELS[1:]))
    from terrace.operators.order import quantiles

    edge = quantiles(listings(spark, sf, ["price"]), [], "price", {"_p95": 0.95})
    return pairs.crossJoin(F.broadcast(edge)).withColumn("is_tail", (F.col("actual") >= F.col("_p95")).cast("int")).drop("_p95")


@query("eval_bootstrap_intervals")
def _(spark, sf):
    return bootstrap.paired_bootstrap(model_pairs(spark, sf), "listing_id", ["reference_model"], draws=5000)


SCORES = "s AS (SELECT doc_id, quality AS label, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS BIGINT) / 16 / CAST(16 AS DOUBLE) * 0.6 + quality * 0.3 AS score FROM labels), t AS (SELECT *, floor(score * 20) / 20 AS sc FROM s)"


def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    base = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("double") / 16 / 16.0 * 0.6 + F.col("quality") * 0.3
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), (F.floor(base * 20) / 20).alias("score"))


@query("eval_classifier", "WITH " + SCORES.replace("/ 16 / CAST(16", "/ CAST(16 AS DOUBLE) / CAST(16") + (
    ", c AS (SELECT count(*) FILTER (WHERE label = 1 AND sc >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND sc >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND sc < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND sc < 0.5) AS tn, avg(pow(sc - label, 2)) AS brier FROM t),"
    " g AS (SELECT sc, count(*) AS n, sum(label) AS p FROM t GROUP BY 1), h AS (SELECT *, sum(n) OVER (ORDER BY sc DESC) AS cn, sum(p) OVER (ORDER BY sc DESC) AS cp, sum(n) OVER () AS tn_, sum(p) OVER () AS tp_ FROM g)"
    " SELECT tp, fp, fn, tn, round(brier, 6) AS brier, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy,"
    " (SELECT round(sum((n - p) * (cp - p + p / 2.0)) / max(tp_ * (tn_ - tp_)), 6) FROM h) AS roc_auc, (SELECT round(sum(p / tp_::DOUBLE * cp / cn), 6) FROM h) AS pr_auc FROM c"))
def _(spark, sf):
    return rounded(evaluate.classifier_metrics(label_scores(spark, sf), 0.5), 6)


@query("eval_routing_impact", with_scored(
    ", l AS (SELECT CASE WHEN actual >= 80000 AND predicted >= 85000 THEN 'TP' WHEN actual >= 80000 THEN 'FN' WHEN predicted >= 85000 THEN 'FP' ELSE 'TN' END AS routing_group, predicted - actual AS e FROM scored) SELECT routing_group, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(avg(e), 4) AS mean_error, round(quantile_cont(e, 0.5), 4) AS median_error FROM l GROUP BY 1"))
def _(spark, sf):
    df = scored(spark, sf).withColumn("truth", (F.col("actual") >= 80000).cast("int")).withColumn("routed", (F.col("predicted") >= 85000).cast("int"))
    return rounded(evaluate.routing_error_impact(df, "truth", "routed"))


@query("eval_quantile_diagnostics", with_scored(
    ", p AS (SELECT actual, predicted * 0.9 AS p10, predicted AS p50, predicted * 1.1 AS p90 FROM scored WHERE model = 'model_a') SELECT round(avg(greatest(0.1 * (actual - p10), -0.9 * (actual - p10))), 4) AS p10_pinball, round(avg(greatest(0.5 * (actual - p50), -0.5 * (actual - p50))), 4) AS p50_pinball,"
    " round(avg(greatest(0.9 * (actual - p90), -0.1 * (actual - p90))), 4) AS p90_pinball, round(avg((actual BETWEEN p10 AND p90)::INT) * 100, 4) AS coverage_pct, round(avg(p90 - p10), 4) AS mean_width, count(*) FILTER (WHERE p10 > p50) AS low_above_mid, count(*) FILTER (WHERE p50 > p90) AS mid_above_high FROM p"))
def _(spark, sf):
    p = F.col("predicted")
    df = scored(spark, sf).where("model = 'model_a'").select("actual", (p * 0.9).alias("p10"), p.alias("p50"), (p * 1.1).alias("p90"))
    return rounded(evaluate.quantile_diagnostics(df))


SCENARIOS = f", sc AS (SELECT CASE fold WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS scenario, model, {METRICS} FROM scored GROUP BY 1, 2)"


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("fold") == 1, "A").when(F.col("fold") == 2, "B").otherwise("C")
    return scored(spark, sf).groupBy(name.alias("scenario"), "model").agg(*evaluate.core_metrics())


@query("eval_stability", with_scored(
    SCENARIOS + ", w AS (SELECT model, " + ", ".join(f"max({m}) FILTER (WHERE scenario = '{s}') AS {m}_{s}" for m in ("rmse", "mae") for s in "ABC") + " FROM sc GROUP BY 1) SELECT model, "
    + ", ".join(f"round({m}_{s}, 4) AS {m}_{s}" for m in ("rmse", "mae") for s in "ABC") + ", " + ", ".join(f"round({m}_{x} - {m}_{y}, 4) AS {m}_{x}_minus_{y}" for m in ("rmse", "mae") for x, y in (("B", "A"), ("C", "B"), ("C", "A"))) + " FROM w"))
def _(spark, sf):
    return rounded(evaluate.stability(scenarios(spark, sf), "model", "scenario", ["rmse", "mae"]))


@query("eval_rankings", with_scored(
    SCENARIOS + " SELECT scenario, string_agg(model, '>' ORDER BY rmse, model) AS rmse_order, string_agg(model, '>' ORDER BY mae, model) AS mae_order, arg_min(model, rmse) AS best_rmse, arg_min(model, mae) AS best_mae, CAST(arg_min(model, rmse) = arg_min(model, mae) AS INTEGER) AS best_by_both FROM sc GROUP BY 1"))
def _(spark, sf):
    return evaluate.rankings(scenarios(spark, sf), "scenario", "model")


GATE = REPORT + ", g AS (SELECT r.model, (r.rmse - b.rmse) AS dr, (r.mae - b.mae) / b.mae * 100 AS dm, r.r2 - b.r2 AS d2 FROM report r, report b WHERE b.model = 'model_a'), j AS (SELECT model, dr, list_filter([CASE WHEN NOT dr < 0 THEN 'improves_rmse' END, CASE WHEN NOT dm <= 0.5 THEN 'mae_within_half_percent' END, CASE WHEN NOT d2 >= 0 THEN 'r2_not_worse' END, CASE WHEN NOT dr / 1e3 <= 5 THEN 'top5_rmse_within_5_percent' END, CASE WHEN NOT dm <= 5 THEN 'top5_mae_within_5_percent' END], lambda x: x IS NOT NULL) AS f FROM g)"


def gate_input(spark: SparkSession, sf: str) -> DataFrame:
    # model_a is compared with itself, too: both sides must be the same sums.
    rep = durable(report(spark, sf, "model"))
    base = rep.where("model = 'model_a'").select(F.col("rmse").alias("_r"), F.col("mae").alias("_m"), F.col("r2").alias("_q"))
    return rep.crossJoin(F.broadcast(base)).select(
        "model", (F.col("rmse") - F.col("_r")).alias("rmse_change"), ((F.col("mae") - F.col("_m")) / F.col("_m") * 100).alias("mae_change_pct"),
        (F.col("r2") - F.col("_q")).alias("r2_change"), ((F.col("rmse") - F.col("_r")) / 1e3).alias("top5_rmse_change_pct"),
        ((F.col("mae") - F.col("_m")) / F.col("_m") * 100).alias("top5_mae_change_pct"))


@query("eval_adoption_gate", with_scored(GATE + " SELECT model, array_to_string(f, ';') AS failed_checks, CAST(len(f) = 0 AS INTEGER) AS passed, coalesce((SELECT model FROM j WHERE len(f) = 0 ORDER BY dr, model LIMIT 1), 'model_a') AS adopted FROM j"))
def _(spark, sf):
    out = evaluate.adoption_gate(gate_input(spark, sf), evaluate.winsor_rules(), [F.asc("rmse_change")], "model", "model_a")
    return out.select("model", "failed_checks", "passed", "adopted")


#: Predictors that the adjusted R2 of the rule sets counts.
RULE_PREDICTORS = 7
RULE_SQL = """, edge AS (SELECT quantile_cont(actual, 0.95) AS e5, quantile_cont(actual, 0.99) AS e1 FROM scored WHERE model = 'model_a'),
 m AS (SELECT model, count(*) AS n, sqrt(avg(power(predicted - actual, 2))) AS rmse, avg(abs(predicted - actual)) AS mae, 1 - avg(power(predicted - actual, 2)) / var_pop(actual) AS r2, avg(predicted - actual) AS mean_error, avg(actual) AS mean_actual,
  sqrt(avg(power(predicted - actual, 2)) FILTER (WHERE actual >= e5)) AS rmse5, avg(abs(predicted - actual)) FILTER (WHERE actual >= e5) AS mae5, sqrt(avg(power(predicted - actual, 2)) FILTER (WHERE actual >= e1)) AS rmse1 FROM scored, edge GROUP BY model),
 f AS (SELECT model, fold, sqrt(avg(power(predicted - actual, 2))) AS rmse, avg(abs(predicted - actual)) AS mae, 1 - avg(power(predicted - actual, 2)) / var_pop(actual) AS r2 FROM scored GROUP BY 1, 2),
 w AS (SELECT f.model, count(*) FILTER (WHERE f.rmse < b.rmse) AS rmse_wins, count(*) FILTER (WHERE f.mae < b.mae) AS mae_wins, avg(f.rmse - b.rmse) + 1.96 * stddev_samp(f.rmse - b.rmse) / sqrt(count(*)) AS rmse_upper,
  avg(f.mae - b.mae) + 1.96 * stddev_samp(f.mae - b.mae) / sqrt(count(*)) AS mae_upper, max(f.r2) - min(f.r2) AS gap, max(b.r2) - min(b.r2) AS base_gap FROM f JOIN f b ON b.fold = f.fold AND b.model = 'model_a' GROUP BY f.model),
 c AS (SELECT m.*, w.* EXCLUDE (model), b.rmse AS brmse, b.mae AS bmae, b.r2 AS br2, b.rmse5 AS brmse5, b.mae5 AS bmae5, b.rmse1 AS brmse1 FROM m JOIN w USING (model) JOIN m b ON b.model = 'model_a'),
 winsor AS (SELECT model, rmse - brmse AS d, ['improves_rmse', 'mae_within_half_percent', 'r2_not_worse', 'top5_rmse_within_5_percent', 'top5_mae_within_5_percent'] AS names,
  [rmse < brmse, (mae - bmae) / bmae * 100 <= 0.5, r2 >= br2, (rmse5 - brmse5) / brmse5 * 100 <= 5, (mae5 - bmae5) / bmae5 * 100 <= 5] AS held, c.* EXCLUDE (model) FROM c),
 sets AS (SELECT 'trim' AS rules, model, d, ['improves_rmse', 'improves_mae', 'rmse_interval_below_zero', 'mae_interval_below_zero', 'rmse_fold_wins', 'mae_fold_wins', 'top5_not_worse', 'top1_not_worse'] AS names,
   [rmse < brmse, mae < bmae, rmse_upper < 0, mae_upper < 0, rmse_wins >= 3, mae_wins >= 3, rmse5 <= brmse5, rmse1 <= brmse1] AS held FROM winsor
  UNION ALL SELECT 'winsor_adjusted', model, d, list_append(names, 'adjusted_r2_not_worse'), list_append(held, (1 - (1 - r2) * (n - 1) / (n - {p} - 1)) >= (1 - (1 - br2) * (n - 1) / (n - {p} - 1))) FROM winsor
  UNION ALL SELECT 'log_target', model, d, list_append(names, 'mean_bias_within_2_percent'), list_append(held, abs(mean_error) <= 0.02 * mean_actual) FROM winsor
  UNION ALL SELECT 'promotion', model, d, ['rmse_gain_1_percent', 'mae_within_half_percent', 'r2_stable', 'top5_rmse_within_5_percent', 'mean_bias_below_2_percent', 'r2_gap_within_0_05', 'rmse_interval_below_zero'],
   [(rmse - brmse) / brmse * 100 <= -1, (mae - bmae) / bmae * 100 <= 0.5, r2 - br2 >= -0.001, (rmse5 - brmse5) / brmse5 * 100 <= 5, abs(mean_error) <= 0.02 * mean_actual, gap <= base_gap + 0.05, rmse_upper < 0] FROM winsor),
 told AS (SELECT rules, model, d, array_to_string(list_filter(names, lambda x, i: NOT coalesce(held[i], FALSE)), ';') AS failed_checks FROM sets),
 best AS (SELECT rules, first(model ORDER BY d, model) AS model FROM told WHERE failed_checks = '' GROUP BY rules)
 SELECT t.rules, t.model, t.failed_checks, CAST(t.failed_checks = '' AS INTEGER) AS passed, coalesce(b.model, 'model_a') AS adopted FROM told t LEFT JOIN best b USING (rules)""".replace("{p}", str(RULE_PREDICTORS))


def rule_input(spark: SparkSession, sf: str) -> DataFrame:
    """Every model against ``model_a``: whole-table, tail and fold metrics, and the upper ends of the fold differences' 95 % intervals."""
    rows = scored(spark, sf)
    edges = quantiles(rows.where("model = 'model_a'"), [], "actual", {"e5": 0.95, "e1": 0.99})
    e = F.col("predicted") - F.col("actual")
    square, size = e * e, F.abs(e)

    def tail(values, edge: str):
        return F.avg(F.when(F.col("actual") >= F.col(edge), values))

    r2 = 1 - F.avg(square) / F.var_pop("actual")
    whole = rows.crossJoin(F.broadcast(edges)).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(square)).alias("rmse"), F.avg(size).alias("mae"), r2.alias("r2"), F.avg(e).alias("mean_error"), F.avg("actual").alias("mean_actual"),
        F.sqrt(tail(square, "e5")).alias("rmse5"), tail(size, "e5").alias("mae5"), F.sqrt(tail(square, "e1")).alias("rmse1"))
    # Both sides of a comparison are the same sums: summed again in another order, model_a would differ from itself.
    whole = durable(whole.withColumn("adjusted", evaluate.adjusted_r2(F.col("r2"), F.col("n"), F.lit(RULE_PREDICTORS))))
    fold = durable(rows.groupBy("model", "fold").agg(F.sqrt(F.avg(square)).alias("rmse"), F.avg(size).alias("mae"), r2.alias("r2")))
    against = fold.join(F.broadcast(fold.where("model = 'model_a'").select("fold", F.col("rmse").alias("b_rmse"), F.col("mae").alias("b_mae"), F.col("r2").alias("b_r2"))), "fold")

    def upper(metric: str):
        d = F.col(metric) - F.col(f"b_{metric}")
        return (F.avg(d) + 1.96 * F.stddev_samp(d) / F.sqrt(F.count(d))).alias(f"{metric}_ci_upper")

    wins = against.groupBy("model").agg(
        F.count_if(F.col("rmse") < F.col("b_rmse")).alias("rmse_fold_wins"), F.count_if(F.col("mae") < F.col("b_mae")).alias("mae_fold_wins"), upper("rmse"), upper("mae"),
        (F.max("r2") - F.min("r2")).alias("r2_gap"), (F.max("b_r2") - F.min("b_r2")).alias("baseline_r2_gap"))
    names = ("rmse", "mae", "r2", "rmse5", "mae5", "rmse1", "adjusted")
    base = whole.where("model = 'model_a'").select(*[F.col(c).alias(f"b_{c}") for c in names])
    change = lambda c: F.col(c) - F.col(f"b_{c}")
    percent = lambda c: change(c) / F.col(f"b_{c}") * 100
    return whole.join(wins, "model").crossJoin(F.broadcast(base)).select(
        "model", "mean_error", "mean_actual", "rmse_fold_wins", "mae_fold_wins", "rmse_ci_upper", "mae_ci_upper", "r2_gap", "baseline_r2_gap",
        change("rmse").alias("rmse_change"), change("mae").alias("mae_change"), percent("rmse").alias("rmse_change_pct"), percent("mae").alias("mae_change_pct"), change("r2").alias("r2_change"),
        change("adjusted").alias("adjusted_r2_change"), change("rmse5").alias("top5_rmse_change"), percent("rmse5").alias("top5_rmse_change_pct"), percent("mae5").alias("top5_mae_change_pct"), change("rmse1").alias("top1_rmse_change"))


@query("eval_adoption_rule_sets", with_scored(RULE_SQL))
def _(spark, sf):
    """The other four rule sets, each with its own choice."""
    found = durable(rule_input(spark, sf))
    sets = {"trim": evaluate.trim_rules(), "winsor_adjusted": evaluate.winsor_rules(with_adjusted=True), "log_target": evaluate.log_target_rules(), "promotion": evaluate.promotion_rules()}
    parts = [evaluate.adoption_gate(found, rules, [F.asc("rmse_change")], "model", "model_a").select(F.lit(name).alias("rules"), "model", "failed_checks", "passed", "adopted") for name, rules in sets.items()]
    return reduce(DataFrame.unionByName, parts)


@query("eval_scope_metrics", with_scored(f", m AS (SELECT model, {METRICS} FROM scored WHERE actual <= 60000 GROUP BY 1) SELECT model, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM m"))
def _(spark, sf):
    return rounded(evaluate.scope_metrics(scored(spark, sf), 60000, ["model"]))


@query("eval_prediction_points", with_scored("SELECT listing_id, actual, round(predicted, 4) AS predicted, round(predicted - actual, 4) AS error FROM scored WHERE model = 'model_b' AND actual <= 60000"))
def _(spark, sf):
    return rounded(evaluate.prediction_points(scored(spark, sf), "model_b", 60000).select("listing_id", "actual", "predicted", "error"))


@query("eval_report_series", with_scored(REPORT + " SELECT model, fold, 'rmse' AS metric, round(rmse, 4) AS value FROM by_fold UNION ALL SELECT model, fold, 'mae', round(mae, 4) FROM by_fold"))
def _(spark, sf):
    return rounded(evaluate.report_long(report(spark, sf, "model", "fold"), ["model", "fold"], ["rmse", "mae"]))


@query("eval_before_after", with_scored(
    f", b AS (SELECT model, {METRICS} FROM scored WHERE fold = 1 GROUP BY 1), a AS (SELECT model, {METRICS} FROM scored WHERE fold = 2 GROUP BY 1) SELECT model, round(b.rmse, 4) AS before_rmse, round(a.rmse, 4) AS after_rmse, round(a.rmse - b.rmse, 4) AS rmse_change, round((a.rmse - b.rmse) / b.rmse * 100, 4) AS rmse_change_pct FROM b JOIN a USING (model)"))
def _(spark, sf):
    df = scored(spark, sf)
    parts = [df.where(F.col("fold") == k).groupBy("model").agg(*evaluate.core_metrics()) for k in (1, 2)]
    return rounded(evaluate.before_after(*parts, "model", ["rmse"]))


# --- model arithmetic with exact answers -----------------------------------


@query("model_targets", with_listings(
    "SELECT listing_id, round(price / property_size_sqft, 9) AS unit, round(ln(1 + price / property_size_sqft), 6) AS log_unit, round(ln(1 + price), 6) AS log_price, round((pow(price, 0.5) - 1) / 0.5, 4) AS boxcox FROM listings"))
def _(spark, sf):
    p, s = F.col("price"), F.col("property_size_sqft")
    return listings(spark, sf, ["listing_id", "price", "property_size_sqft"]).select(
        "listing_id", F.round(to_target("unit", p, s), 9).alias("unit"), F.round(to_target("log_unit", p, s), 6).alias("log_unit"),
        F.round(to_target("log_price", p, s), 6).alias("log_price"), F.round(to_target("boxcox", p, s, 0.5), 4).alias("boxcox"))


GRID = (-0.5, 0.0, 0.5, 1.0)


@query("model_boxcox_likelihood", with_listings(" UNION ALL ".join(
    f"SELECT {lam}::DOUBLE AS lam, round(-0.5 * ln(var_pop({'ln(price)' if lam == 0 else f'(pow(price, {lam}) - 1) / {lam}'})) + ({lam} - 1) * avg(ln(price)), 5) AS log_likelihood FROM listings" for lam in GRID)))
def _(spark, sf):
    return rounded(models.boxcox_likelihoods(listings(spark, sf, ["price"]), "price", GRID), 5)


@query("model_smearing", with_scored("SELECT model, fold, round(avg(exp(ln(1 + actual) - ln(1 + predicted))), 6) AS smearing FROM scored GROUP BY 1, 2"))
def _(spark, sf):
    df = scored(spark, sf).withColumn("residual", F.log1p("actual") - F.log1p("predicted"))
    return rounded(models.smearing_factor(df, "residual", ["model", "fold"]), 6)


STATUS = "CASE WHEN predicted > 30000 THEN predicted END"


@query("model_compare_scopes", with_scored(
    ", a AS (SELECT model, listing_id, CASE WHEN predicted > 30000 THEN predicted END AS p FROM scored WHERE fold <> 1), b AS (SELECT model, listing_id, CASE WHEN predicted * 1.02 < 90000 THEN predicted * 1.02 END AS q FROM scored WHERE fold <> 2)"
    " SELECT model, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN 'Available' WHEN p IS NOT NULL THEN 'Full-market prediction unavailable' WHEN q IS NOT NULL THEN 'Selected-scope prediction unavailable' ELSE 'Prediction unavailable' END AS status, count(*) AS n, round(avg(p - q), 4) AS mean_difference, round(avg((p - q) / q * 100), 4) AS mean_difference_pct FROM a FULL JOIN b USING (model, listing_id) GROUP BY 1, 2"))
def _(spark, sf):
    df, p = scored(spark, sf), F.col("predicted")
    a = df.where("fold <> 1").select("model", "listing_id", F.when(p > 30000, p).alias("predicted_total"))
    b = df.where("fold <> 2").select("model", "listing_id", F.when(p * 1.02 < 90000, p * 1.02).alias("predicted_total"))
    out = models.compare_scopes(a, b, "listing_id")
    return rounded(out.groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("difference").alias("mean_difference"), F.avg("difference_pct").alias("mean_difference_pct")))


@query("model_select_threshold", "WITH " + SCORES.replace("/ 16 / CAST(16", "/ CAST(16 AS DOUBLE) / CAST(16") + (
    ", h AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND sc >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND sc >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND sc < threshold) AS fn FROM t CROSS JOIN h GROUP BY 1)"
    " SELECT threshold, round(CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5.0 * tp / (5 * tp + 4 * fn + fp) ELSE 0.0 END, 6) AS f2 FROM c"))
def _(spark, sf):
    return rounded(models.select_threshold(label_scores(spark, sf)), 6)


@query("model_routes", with_scored(
    ", w AS (SELECT listing_id, w % 101 / CAST(100 AS DOUBLE) AS p, max(predicted) FILTER (WHERE model = 'model_a') AS s, max(predicted) FILTER (WHERE model = 'model_b') AS e FROM scored GROUP BY 1, 2) SELECT listing_id, round(CASE WHEN p >= 0.5 THEN e ELSE s END, 8) AS hard_route, round((1 - p) * s + p * e, 8) AS soft_route FROM w"))
def _(spark, sf):
    wide = stats.wide_predictions(scored(spark, sf), "listing_id", list(MODELS))
    p = F.conv(F.substring(F.md5("listing_id"), 9, 6), 16, 10).cast("long") % 101 / F.lit(100.0)
    s, e = F.col("prediction__model_a"), F.col("prediction__model_b")
    return rounded(wide.withColumn("p", p).select("listing_id", models.route_hard(F.col("p"), 0.5, s, e).alias("hard_route"), models.route_soft(F.col("p"), s, e).alias("soft_route")), 8)


# The two-model weight has a closed form; clipping it to [0, 1] keeps it on the simplex.
@query("model_blend", with_scored(
    ", w AS (SELECT listing_id, max(actual) AS y, max(predicted) FILTER (WHERE model = 'model_a') AS a, max(predicted) FILTER (WHERE model = 'model_b') AS b FROM scored GROUP BY 1), k AS (SELECT least(greatest(avg((y - b) * (a - b)) / avg((a - b) * (a - b)), 0), 1) AS wa FROM w)"
    " SELECT round(wa, 6) AS weight_a, round(1 - wa, 6) AS weight_b, (SELECT round(sqrt(avg(pow(wa * a + (1 - wa) * b - y, 2))), 4) FROM w) AS rmse FROM k"))
def _(spark, sf):
    wide = scored(spark, sf).groupBy("listing_id").agg(
        F.max("actual").alias("actual"), *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in MODELS[:2]])
    weights = models.blend_weights(wide, list(MODELS[:2]))
    out = models.blend(wide, weights).agg(F.sqrt(F.avg(F.pow(F.col("blended") - F.col("actual"), F.lit(2.0)))).alias("rmse"))
    return out.select(F.round(F.lit(weights["model_a"]), 6).alias("weight_a"), F.round(F.lit(weights["model_b"]), 6).alias("weight_b"), F.round("rmse", 4).alias("rmse"))


@query("model_select_complementary", with_scored(
    ", r AS (SELECT listing_id, model, predicted - actual AS d FROM scored), e AS (SELECT model, sqrt(avg(d * d)) AS rmse FROM r GROUP BY 1),"
    " k AS (SELECT a.model AS x, b.model AS y, abs(corr(a.d, b.d)) AS c FROM r a JOIN r b USING (listing_id) GROUP BY 1, 2),"
    " p1 AS (SELECT model FROM e ORDER BY rmse, model LIMIT 1),"
    " p2 AS (SELECT e.model FROM e JOIN k ON e.model = k.x WHERE k.y IN (FROM p1) AND e.model NOT IN (FROM p1) GROUP BY e.model, rmse ORDER BY rmse > 1.1 * (SELECT min(rmse) FROM e), avg(c), rmse, e.model LIMIT 1),"
    " two AS (FROM p1 UNION ALL FROM p2),"
    " p3 AS (SELECT e.model FROM e JOIN k ON e.model = k.x WHERE k.y IN (FROM two) AND e.model NOT IN (FROM two) GROUP BY e.model, rmse ORDER BY rmse > 1.1 * (SELECT min(rmse) FROM e), avg(c), rmse, e.model LIMIT 1)"
    " SELECT 1 AS position, model FROM p1 UNION ALL SELECT 2, model FROM p2 UNION ALL SELECT 3, model FROM p3"))
def _(spark, sf):
    df = scored(spark, sf)
    return models.select_complementary(stats.residual_correlation_matrix(df, "listing_id", list(MODELS)), report(spark, sf, "model"))


@query("model_gated_blend", with_scored(
    ", w AS (SELECT listing_id, max(actual) AS y, max(predicted) FILTER (WHERE model = 'model_a') AS a, max(predicted) FILTER (WHERE model = 'model_c') AS c FROM scored GROUP BY 1), g AS (SELECT corr(a - y, c - y) AS r FROM w) SELECT listing_id, CAST(r < 0.9 AS INTEGER) AS gate_open, round(CASE WHEN r < 0.9 THEN 0.8 * a + (1.0 - 0.8) * c ELSE a END, 4) AS blended FROM w, g"))
def _(spark, sf):
    wide = scored(spark, sf).groupBy("listing_id").agg(
        F.max("actual").alias("actual"), *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in ("model_a", "model_c")])
    return rounded(models.gated_blend(wide, "model_a", "model_c").select("listing_id", "gate_open", "blended"))


@query("model_conditional_quantiles", with_scored(
    ", s AS (SELECT * FROM scored WHERE model = 'model_a'), e AS (SELECT quantile_cont(predicted, [0.25, 0.5, 0.75]) AS q FROM s), b AS (SELECT listing_id, actual, predicted, (predicted >= q[1])::INT + (predicted >= q[2])::INT + (predicted >= q[3])::INT AS band FROM s, e),"
    " h AS (SELECT band, quantile_cont(actual - predicted, [0.1, 0.5, 0.9]) AS q FROM b GROUP BY 1) SELECT listing_id, CAST(band AS INTEGER) AS prediction_band, round(predicted + q[1], 7) AS p10, round(predicted + q[2], 7) AS p50, round(predicted + q[3], 7) AS p90 FROM b JOIN h USING (band)"))
def _(spark, sf):
    out = models.conditional_quantiles(scored(spark, sf).where("model = 'model_a'"), bands=4)
    return rounded(out.select("listing_id", "prediction_band", "p10", "p50", "p90"), 7)


@query("model_sample_weights", with_listings(", r AS (SELECT listing_id, pow(price, -0.5) AS v FROM listings) SELECT listing_id, round(v / (SELECT avg(v) FROM r), 6) AS weight FROM r"))
def _(spark, sf):
    return rounded(models.sample_weights(listings(spark, sf, ["listing_id", "price"]), "price", 0.5).select("listing_id", "weight"), 6)


# --- quality ---------------------------------------------------------------


@query("quality_raw_profile", with_listings(", g AS (SELECT count(*) AS n FROM (SELECT city, price, bedroom FROM listings) GROUP BY city, price, bedroom) SELECT CAST(sum(n) AS BIGINT) AS rows, 3 AS columns, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g"))
def _(spark, sf):
    return quality.validate_raw(listings(spark, sf, ["city", "price", "bedroom"]), ["city", "price"])


@query("quality_sanitize", raw_sql("SELECT listing_id, TRY_CAST(regexp_replace(count_text, '^ +| +$', '', 'g') AS DOUBLE) AS count_text, row_seq::DOUBLE AS row_seq FROM raw WHERE TRY_CAST(regexp_replace(count_text, '^ +| +$', '', 'g') AS DOUBLE) IS NOT NULL", "count_text", "row_seq"))
def _(spark, sf):
    return quality.sanitize(raw(spark, sf, "count_text", "row_seq"), "count_text", ["row_seq"], ["listing_id"])


@query("quality_prepared", with_listings(
    ", g AS (SELECT city, price, count(*) AS n FROM listings GROUP BY 1, 2) SELECT (SELECT count(*) FROM listings) AS rows, 0::BIGINT AS target_missing, 0::BIGINT AS target_infinite, 0::BIGINT AS target_nonpositive, 0::BIGINT AS rows_with_infinite, (SELECT 2 * count(*) - count(completion_year) - count(total_units) FROM listings) AS missing_cells, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g"))
def _(spark, sf):
    return quality.validate_prepared(listings(spark, sf, ["city", "price", "completion_year", "total_units"]), "price", ["completion_year", "total_units"], ["city", "price"])


@query("quality_positive_finite", with_listings(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL OR {c} <= 0) AS violations FROM listings" for c in ("price", "bathroom", "total_units"))))
def _(spark, sf):
    columns = ["price", "bathroom", "total_units"]
    return quality.positive_finite_report(listings(spark, sf, columns), columns)


@query("quality_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return quality.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("quality_partition", with_listings(FOLDED + " SELECT gfold AS fold, count(*) AS validation_rows, (SELECT count(*) FROM f) AS ids, 0::BIGINT AS ids_not_once, (SELECT count(*) FROM f) - count(*) AS training_rows, 4 AS trained_times FROM f GROUP BY 1"))
def _(spark, sf):
    df = with_folds(spark, sf)
    quality.expect_partition(df, "listing_id", "fold", 5)
    return quality.partition_report(df, "listing_id", "fold", 5)


@query("quality_groups_crossing", with_listings(FOLDED + " SELECT building_name, count(DISTINCT gfold) AS folds FROM f GROUP BY 1 HAVING count(DISTINCT gfold) > 1"))
def _(spark, sf):
    return quality.groups_crossing_folds(with_folds(spark, sf, "building_name"), "building_name", "fold")


@query("quality_fold_set", with_scored("SELECT '1,2,3,4,5' AS folds, 0::BIGINT AS ids_with_several_folds"))
def _(spark, sf):
    df = scored(spark, sf)
    return quality.fold_set_report(df, "listing_id", "fold")


@query("quality_oof_coverage", with_scored(", p AS (SELECT * FROM scored WHERE NOT (model = 'model_b' AND fold = 2)) SELECT model, count(DISTINCT listing_id) AS ids, 0::BIGINT AS repeated, 0::BIGINT AS non_finite, 0::BIGINT AS foreign_ids, (SELECT count(*) FROM listings) - count(DISTINCT listing_id) AS unscored FROM p GROUP BY 1"))
def _(spark, sf):
    part = scored(spark, sf).where("NOT (model = 'model_b' AND fold = 2)")
    return quality.oof_coverage(part, "listing_id", listings(spark, sf, ["listing_id"]))


@query("quality_grid", with_scored(", c AS (SELECT model, fold, count(*) AS n FROM scored WHERE NOT (model = 'model_b' AND fold = 2) GROUP BY 1, 2) SELECT count(*) AS cells, 20 - count(*) AS missing_cells, min(n) AS smallest, max(n) AS largest FROM c"))
def _(spark, sf):
    return quality.grid_report(scored(spark, sf).where("NOT (model = 'model_b' AND fold = 2)"), ["model", "fold"], 20)


@query("quality_metrics_reproduce", with_scored(REPORT + " SELECT model, CAST(model <> 'model_c' AS INTEGER) AS reproduced FROM report"))
def _(spark, sf):
    found = report(spark, sf, "model")
    saved = found.withColumn("rmse", F.when(F.col("model") == "model_c", F.col("rmse") + 1).otherwise(F.col("rmse")))
    return quality.metrics_match(found, saved, ["model"], ["rmse", "mae", "r2"]).select("model", "reproduced")


@query("quality_split_groups", "WITH a AS (SELECT doc_id, lang || source AS g FROM documents), b AS (SELECT doc_id, source || '-' || (n_chars % 3) AS g FROM documents) SELECT a.g AS fine_group, count(DISTINCT b.g) AS parts FROM a JOIN b USING (doc_id) GROUP BY 1 HAVING count(DISTINCT b.g) > 1")
def _(spark, sf):
    df = table(spark, sf, "documents")
    fine = df.select("doc_id", F.concat("lang", "source").alias("g"))
    coarse = df.select("doc_id", F.concat_ws("-", "source", (F.col("n_chars") % 3).cast("string")).alias("g"))
    return quality.split_groups(fine, coarse, "doc_id", "g")


@query("quality_leakage", with_scored(
    ", c AS (SELECT DISTINCT model, building_name || '/' || bedroom || '/' || parking_lot || '/' || bathroom AS grp, fold FROM scored), n AS (SELECT model, grp, count(*) AS k FROM c GROUP BY 1, 2) SELECT model, fold, count(*) AS validation_groups, count(*) FILTER (WHERE k > 1) AS overlapping_groups FROM c JOIN n USING (model, grp) GROUP BY 1, 2"))
def _(spark, sf):
    df = scored(spark, sf, ["building_name", "bedroom", "parking_lot", "bathroom"]).withColumn("grp", F.concat_ws("/", "building_name", "bedroom", "parking_lot", "bathroom"))
    return quality.leakage_audit(df, "grp", by=["model"])


@query("quality_input_errors", with_listings(
    ", e AS (SELECT listing_id, list_filter([CASE WHEN completion_year IS NULL THEN 'completion_year must be a finite number' END, CASE WHEN total_units IS NULL THEN 'total_units must be a finite number' END], lambda x: x IS NOT NULL) AS a,"
    " list_filter([CASE WHEN completion_year > 2030 THEN 'completion_year must be between 1800 and 2030' END, CASE WHEN total_units <= 0 THEN 'total_units must be greater than zero' END], lambda x: x IS NOT NULL) AS b FROM listings) SELECT listing_id, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, ';') AS errors FROM e"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "completion_year", "total_units"])
    return quality.input_errors(df, ["completion_year", "total_units"]).select("listing_id", F.array_join("errors", ";").alias("errors"))


@query("quality_outside_ranges", with_listings(
    ", r AS (SELECT min(price) AS p0, max(price) AS p1, min(bathroom) AS b0, max(bathroom) AS b1 FROM listings WHERE tenure_type = 'A' AND price < 90000) SELECT listing_id, array_to_string(list_filter([CASE WHEN price < p0 OR price > p1 THEN 'price' END, CASE WHEN bathroom < b0 OR bathroom > b1 THEN 'bathroom' END], lambda x: x IS NOT NULL), ';') AS outside_range FROM listings, r"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "price", "bathroom", "tenure_type"])
    ranges = stats.observed_ranges(df.where("tenure_type = 'A' AND price < 90000"), ["price", "bathroom"])
    return quality.outside_ranges(df, ranges, ["price", "bathroom"]).select("listing_id", F.array_join("outside_range", ";").alias("outside_range"))


AUDIT_TYPES = ("ECONOMY", "PROMO")


def audited(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["listing_id", "price", "property_size_sqft", "property_type", "building_name", "developer", "city", "state", "bedroom", "bathroom", "parking_lot", "completion_year", "number_of_floors", "total_units", "floor_range"]
    df = listings(spark, sf, columns)
    text = raw(spark, sf, "description")
    scaled = df.withColumns({"property_size_sqft": F.col("property_size_sqft") * 30, "bedroom": F.col("bedroom") * 2, "number_of_floors": F.col("number_of_floors") * 2})
    return audit.validity_audit(scaled.join(text, "listing_id"), order="listing_id", strata=AUDIT_TYPES)


SIZES_SQL = (r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(replace(tx, ',', ''), '(?i)(?:^|[^0-9])([0-9]{3,5}(?:\.[0-9]+)?)\s*(?:sq\.?\s*ft|sqft|sft|sf)\b', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 100 AND 20000)))")
PRICES_SQL = (r"list_distinct(list_filter(list_transform(list_zip(regexp_extract_all(replace(tx, ',', ''), '(?i)\brm\s*([0-9]+(?:\.[0-9]+)?)\s*([km]?)\b', 1), regexp_extract_all(replace(tx, ',', ''), '(?i)\brm\s*([0-9]+(?:\.[0-9]+)?)\s*([km]?)\b', 2)),"
              r" lambda x: CAST(x[1] AS DOUBLE) * CASE lower(x[2]) WHEN 'k' THEN 1000.0 WHEN 'm' THEN 1000000.0 ELSE 1.0 END), lambda x: x >= 30000))")
_PARK = r"(?:car\s*parks?|parking(?:\s*lots?)?)"
AUDIT_SQL = with_listings(
    f", r AS (SELECT {KEY.format(date='strftime(l_shipdate, ' + repr('%Y%m%d') + ')')} AS listing_id, {RAW['description'].format(s='VARCHAR')} AS d FROM lineitem),"
    " a0 AS (SELECT l.* EXCLUDE (property_size_sqft, bedroom, number_of_floors), property_size_sqft * 30 AS sz, bedroom * 2 AS bedroom, number_of_floors * 2 AS number_of_floors, lower(coalesce(d, '')) AS tx FROM listings l JOIN r USING (listing_id)),"
    f" a AS (SELECT *, {SIZES_SQL} AS sizes, {PRICES_SQL} AS prices, count(*) OVER (PARTITION BY price, sz, property_type, building_name, developer, city, state, bedroom, bathroom, parking_lot, completion_year, number_of_floors, total_units, floor_range) AS copies FROM a0),"
    " b AS (SELECT *, list_filter([CASE WHEN sz < 100 OR sz > 20000 THEN 'OUTSIDE_BROAD_SIZE_DOMAIN' END,"
    r" CASE WHEN regexp_matches(tx, '\bselling\s+(?:two|2)\s+units?\b') AND len(sizes) >= 2 AND len(prices) >= 2 THEN 'MULTI_UNIT_BUNDLE_NOT_SINGLE_OBSERVATION' END,"
    r" CASE WHEN bedroom >= 8 AND regexp_matches(tx, '\b3\s*[- ]?bedrooms?\b') AND NOT regexp_matches(tx, '\b8\s*[- ]?bedrooms?\b') THEN 'BEDROOM_COUNT_DESCRIPTION_CONTRADICTION' END,"
    r" CASE WHEN bathroom >= 6 AND sz < 600 AND bathroom > bedroom + 3 AND regexp_matches(tx, '\b2\s*[- ]?(?:bathrooms?|baths?)\b') THEN 'BATHROOM_COUNT_CONFIGURATION_CONTRADICTION' END,"
    " CASE WHEN copies > 1 THEN 'POSSIBLE_REPEAT_DIFFERENT_LISTING_ID' END, CASE WHEN number_of_floors >= 80 THEN 'ISOLATED_FLOOR_COUNT_NEEDS_REVIEW' END,"
    " CASE WHEN property_type IN ('ECONOMY', 'PROMO') AND (total_units <= 3 OR total_units >= 5000) THEN 'STRATA_TOTAL_UNITS_NEEDS_REVIEW' END,"
    rf" CASE WHEN parking_lot >= 5 AND NOT (regexp_matches(tx, concat('(?i)\b', parking_lot, '\s*[- ]?{_PARK}\b')) OR regexp_matches(tx, concat('(?i)\b{_PARK}\s*[:\-]?\s*', parking_lot, '\b'))) THEN 'UNSUPPORTED_HIGH_PARKING_COUNT' END,"
    " CASE WHEN len(sizes) = 1 AND abs(sizes[1] - sz) / sz > 0.10 THEN 'SINGLE_DESCRIPTION_SIZE_MISMATCH' END,"
    " CASE WHEN total_units < 1 THEN 'OPTIONAL_FLOOR_OR_UNIT_DOMAIN_NEEDS_REVIEW' END], lambda x: x IS NOT NULL) AS fired FROM a),"
    " c AS (SELECT *, CASE WHEN list_has_any(fired, ['OUTSIDE_BROAD_SIZE_DOMAIN', 'MULTI_UNIT_BUNDLE_NOT_SINGLE_OBSERVATION', 'BEDROOM_COUNT_DESCRIPTION_CONTRADICTION', 'BATHROOM_COUNT_CONFIGURATION_CONTRADICTION']) THEN 'CLEARLY_INVALID' WHEN len(fired) > 0 THEN 'SUSPICIOUS' ELSE 'VALID' END AS validity_status FROM b)")


@query("quality_validity_audit", AUDIT_SQL + " SELECT listing_id, array_to_string(fired, ';') AS rules_fired, validity_status, CASE validity_status WHEN 'CLEARLY_INVALID' THEN 'REMOVE_FROM_EXPERIMENT_ONLY' WHEN 'SUSPICIOUS' THEN 'RETAIN_PENDING_REVIEW' ELSE 'RETAIN' END AS recommended_action FROM c")
def _(spark, sf):
    return audited(spark, sf).select("listing_id", F.array_join("rules_fired", ";").alias("rules_fired"), "validity_status", "recommended_action")


SAME_ROW = "price, sz, property_type, building_name, developer, city, state, bedroom, bathroom, parking_lot, completion_year, number_of_floors, total_units, floor_range"


@query("quality_audit_evidence", AUDIT_SQL + (
    f", s AS (SELECT *, CASE WHEN copies > 1 THEN min(listing_id) OVER (PARTITION BY {SAME_ROW}) END AS repeat_group, count(*) OVER (PARTITION BY {SAME_ROW}, tx) > 1 AS same_text FROM c),"
    " e AS (SELECT *, unnest(fired) AS rule FROM s),"
    # Field, value and bounds by rule.
    " f AS (SELECT listing_id, rule, repeat_group, same_text, unnest(CASE rule"
    " WHEN 'OUTSIDE_BROAD_SIZE_DOMAIN' THEN {'field': 'property_size_sqft', 'value': sz::DOUBLE, 'low': 100::DOUBLE, 'high': 20000::DOUBLE, 'span': NULL::VARCHAR}"
    r" WHEN 'MULTI_UNIT_BUNDLE_NOT_SINGLE_OBSERVATION' THEN {'field': 'description', 'value': least(len(sizes), len(prices))::DOUBLE, 'low': NULL, 'high': 1, 'span': regexp_extract(tx, '\bselling\s+(?:two|2)\s+units?\b')}"
    r" WHEN 'BEDROOM_COUNT_DESCRIPTION_CONTRADICTION' THEN {'field': 'bedroom', 'value': bedroom::DOUBLE, 'low': NULL, 'high': 7, 'span': regexp_extract(tx, '\b3\s*[- ]?bedrooms?\b')}"
    r" WHEN 'BATHROOM_COUNT_CONFIGURATION_CONTRADICTION' THEN {'field': 'bathroom', 'value': bathroom::DOUBLE, 'low': NULL, 'high': bedroom + 3, 'span': regexp_extract(tx, '\b2\s*[- ]?(?:bathrooms?|baths?)\b')}"
    " WHEN 'POSSIBLE_REPEAT_DIFFERENT_LISTING_ID' THEN {'field': 'listing_id', 'value': copies::DOUBLE, 'low': NULL, 'high': 1, 'span': NULL}"
    " WHEN 'ISOLATED_FLOOR_COUNT_NEEDS_REVIEW' THEN {'field': 'number_of_floors', 'value': number_of_floors::DOUBLE, 'low': NULL, 'high': 79, 'span': NULL}"
    " WHEN 'STRATA_TOTAL_UNITS_NEEDS_REVIEW' THEN {'field': 'total_units', 'value': total_units::DOUBLE, 'low': 4, 'high': 4999, 'span': NULL}"
    " WHEN 'UNSUPPORTED_HIGH_PARKING_COUNT' THEN {'field': 'parking_lot', 'value': parking_lot::DOUBLE, 'low': NULL, 'high': 4, 'span': NULL}"
    " WHEN 'SINGLE_DESCRIPTION_SIZE_MISMATCH' THEN {'field': 'property_size_sqft', 'value': sz::DOUBLE, 'low': sizes[1] / 1.1::DOUBLE, 'high': sizes[1] / 0.9::DOUBLE, 'span': NULL}"
    " ELSE {'field': 'total_units', 'value': total_units::DOUBLE, 'low': 1, 'high': 20000, 'span': NULL} END) FROM e)"
    " SELECT listing_id, rule, field, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high, span, repeat_group, same_text FROM f"))
def _(spark, sf):
    rows = audit.exploded(audited(spark, sf).select("listing_id", "repeat_group", "same_text", "evidence"), "evidence", "e").select("listing_id", "e.*", "repeat_group", "same_text")
    return rounded(rows, 6)


@query("quality_audit_diagnostics", AUDIT_SQL + (
    ", q AS (SELECT quantile_cont(price / sz, 0.005) AS u0, quantile_cont(price / sz, 0.995) AS u1, quantile_cont(price, 0.95) AS p95, quantile_cont(price, 0.99) AS p99 FROM c)"
    " SELECT validity_status, count(*) AS rows, CAST(sum((price / sz <= u0 OR price / sz >= u1)::INT) AS BIGINT) AS ppsf_extreme, CAST(sum((bedroom >= 6 OR bathroom >= 6 OR parking_lot >= 5 OR sz < 400 OR sz > 5000 OR coalesce(number_of_floors >= 60, false) OR coalesce(total_units >= 3600, false))::INT) AS BIGINT) AS physical_extreme,"
    " CAST(sum((price >= p95)::INT) AS BIGINT) AS top5, CAST(sum((price >= p99)::INT) AS BIGINT) AS top1, CAST(sum((completion_year IS NULL)::INT + (number_of_floors IS NULL)::INT + (total_units IS NULL)::INT + (developer IS NULL)::INT) AS BIGINT) AS optional_missing FROM c, q GROUP BY 1"))
def _(spark, sf):
    return audited(spark, sf).groupBy("validity_status").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in ("ppsf_extreme", "physical_extreme", "top5", "top1")],
        F.sum("optional_missing_count").alias("optional_missing"))


@query("quality_rule_counts", AUDIT_SQL + " SELECT rule, count(*) AS rows FROM (SELECT unnest(fired) AS rule FROM c) GROUP BY 1")
def _(spark, sf):
    return audit.exploded(audited(spark, sf).select("rules_fired"), "rules_fired", "rule").groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("quality_remove_and_compare", AUDIT_SQL.replace("listings AS (", "listings AS (", 1) + (
    ", o AS (SELECT listing_id, price AS actual, 0.1 * price * (bedroom - 7) / 7 AS e, validity_status <> 'CLEARLY_INVALID' AS kept FROM c), x AS (SELECT 'base' AS model, actual, e, e * 0.9 AS g, kept FROM o) " + MATCHED))
def _(spark, sf):
    # Read three times below, so the audit is written once.
    checked = durable(audited(spark, sf).select("listing_id", "price", "bedroom", "validity_status"), "checked")
    base = checked.select("listing_id", F.lit("base").alias("model"), F.col("price").alias("actual"), (F.col("price") + 0.1 * F.col("price") * (F.col("bedroom") - 7) / 7).alias("predicted"))
    again = base.withColumn("predicted", F.col("actual") + (F.col("predicted") - F.col("actual")) * 0.9)
    return rounded(audit.remove_flagged_and_compare(base, checked.select("listing_id", "validity_status"), again, "listing_id", ["model"]))


# --- group assignment table ------------------------------------------------


@query("fold_assignment_table", NUMBERED + f" SELECT 'B' AS scenario, doc_id AS row_index, doc_id, group_id, repeat_group_id, is_grouped_repeat, group_size, {sql_fold('group_id', 5, 42)} AS fold FROM named")
def _(spark, sf):
    from terrace.operators import folds

    grouped = folds.assign_group_kfold(numbered(spark, sf), "group_id").withColumn("row_index", F.col("doc_id"))
    return folds.fold_assignment_table(grouped, "B", "doc_id", "row_index")


# --- geo -------------------------------------------------------------------

LAT = "CASE WHEN {k} % 50 = 0 THEN NULL WHEN {k} % 77 = 0 THEN 95.0 WHEN {k} % 3 = 0 THEN 1.1 + ({k} * 31 % 5) / CAST(10 AS DOUBLE) ELSE 1.0 + ({k} * 7919 % 9973) / CAST(9973 AS DOUBLE) END"
LON = "CASE WHEN {k} % 41 = 0 THEN 90.0 WHEN {k} % 3 = 0 THEN 101.2 + ({k} * 17 % 4) / CAST(10 AS DOUBLE) ELSE 101.0 + ({k} * 104729 % 19997) / CAST(10000 AS DOUBLE) END"
PLACES = f"p AS (SELECT c_custkey AS listing_id, CAST({LAT.format(k='c_custkey')} AS DOUBLE) AS lat, CAST({LON.format(k='c_custkey')} AS DOUBLE) AS lon, c_acctbal + 1500 AS unit, {sql_fold('c_custkey', 5, 42)} AS fold FROM customer), ok AS (SELECT * FROM p WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"
DIST = "2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0), 1)))"


def places(spark: SparkSession, sf: str) -> DataFrame:
    from terrace.operators.folds import hash_fold

    return table(spark, sf, "customer").selectExpr("c_custkey AS listing_id", f"CAST({LAT.format(k='c_custkey')} AS DOUBLE) AS lat", f"CAST({LON.format(k='c_custkey')} AS DOUBLE) AS lon", "c_acctbal + 1500 AS unit").withColumn("fold", hash_fold(F.col("listing_id"), 5, 42))


@query("geo_coordinates", f"WITH {PLACES} SELECT count(*) FILTER (WHERE lat IS NOT NULL AND lat BETWEEN -90 AND 90) AS valid_count, count(*) FILTER (WHERE lat IS NULL) AS missing_count, count(*) FILTER (WHERE lat > 90) AS invalid_count, count(*) FILTER (WHERE lat BETWEEN -90 AND 90 AND NOT (lat BETWEEN 0.5 AND 7.5 AND lon BETWEEN 99 AND 120)) AS outside_country_count, round(count(*) FILTER (WHERE lat IS NOT NULL AND lat BETWEEN -90 AND 90) * 100.0 / count(*), 4) AS coverage_pct FROM p")
def _(spark, sf):
    return rounded(geo.coordinate_counts(places(spark, sf)))


@query("geo_haversine", f"WITH {PLACES} SELECT a.listing_id, round({DIST}, 6) AS distance_km FROM ok a CROSS JOIN (SELECT 3.139 AS lat, 101.6869 AS lon) b")
def _(spark, sf):
    df = places(spark, sf).where("lat BETWEEN -90 AND 90")
    return rounded(df.select("listing_id", haversine_km(F.col("lat"), F.col("lon"), F.lit(3.139), F.lit(101.6869)).alias("distance_km")), 6)


@query("geo_radius_counts", f"WITH {PLACES}, d AS (SELECT a.listing_id, {DIST} AS d FROM ok a JOIN ok b ON a.listing_id <> b.listing_id), g AS (SELECT listing_id, count(*) FILTER (WHERE d <= 1) AS n1, count(*) FILTER (WHERE d <= 3) AS n3, count(*) FILTER (WHERE d <= 5) AS n5, count(*) FILTER (WHERE d <= 10) AS n10 FROM d GROUP BY 1)"
       " SELECT listing_id, CASE WHEN o.lat IS NOT NULL THEN coalesce(n1, 0) END AS within_1km, CASE WHEN o.lat IS NOT NULL THEN coalesce(n3, 0) END AS within_3km, CASE WHEN o.lat IS NOT NULL THEN coalesce(n5, 0) END AS within_5km, CASE WHEN o.lat IS NOT NULL THEN coalesce(n10, 0) END AS within_10km FROM p LEFT JOIN ok o USING (listing_id) LEFT JOIN g USING (listing_id)")
def _(spark, sf):
    df = places(spark, sf)
    return geo.radius_counts(df, df, "listing_id", exclude_self=True).select("listing_id", *[f"within_{r}km" for r in (1, 3, 5, 10)])


RANKED = f"WITH {PLACES}, d AS (SELECT a.listing_id, b.listing_id AS other, b.unit, round({DIST}, 9) AS d FROM ok a JOIN ok b ON {{on}}), r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY d, other) AS r FROM d), k AS (SELECT * FROM r WHERE r <= 20)"


@query("geo_nearest", RANKED.format(on="a.listing_id <> b.listing_id") + " SELECT listing_id, CAST(r AS INTEGER) AS rank, other, round(d, 6) AS distance_km FROM k WHERE r <= 5")
def _(spark, sf):
    df = places(spark, sf)
    found = geo.nearest(df, df, 5, "listing_id", exclude_self=True)
    out = found.where("neighbours IS NOT NULL").select("listing_id", F.posexplode("neighbours").alias("i", "n"))
    return rounded(out.select("listing_id", (F.col("i") + 1).alias("rank"), F.col("n.id").alias("other"), "n.distance_km"), 6)


@query("geo_features", RANKED.format(on="a.listing_id <> b.listing_id") + (
    ", g AS (SELECT listing_id, min(d) AS nearest_km, " + ", ".join(f"avg(d) FILTER (WHERE r <= {k}) AS knn_{k}_mean_km" for k in (3, 5, 10, 20)) + ", max(d) FILTER (WHERE r <= 5) AS knn_5_max_km, max(d) FILTER (WHERE r <= 10) AS knn_10_max_km, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE d <= {r}) AS INTEGER) AS near_within_{r}km" for r in (1, 3, 5, 10)) + " FROM k GROUP BY 1) SELECT p.listing_id, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("nearest_km", *[f"knn_{k}_mean_km" for k in (3, 5, 10, 20)], "knn_5_max_km", "knn_10_max_km")) + ", " + ", ".join(f"near_within_{r}km" for r in (1, 3, 5, 10)) + " FROM p LEFT JOIN g ON p.listing_id = g.listing_id"))
def _(spark, sf):
    return rounded(geo.geo_features(places(spark, sf)).drop("lat", "lon", "unit", "fold"), 6)


PRICED = (", g AS (SELECT listing_id, " + ", ".join(f"quantile_cont(unit, 0.5) FILTER (WHERE r <= {k}) AS knn_{k}_median_unit" for k in (5, 10, 20)) + ", " + ", ".join(f"avg(unit) FILTER (WHERE r <= {k}) AS knn_{k}_mean_unit" for k in (5, 10))
          + ", sum(unit / (d + 0.001)) FILTER (WHERE r <= 10) / sum(1 / (d + 0.001)) FILTER (WHERE r <= 10) AS knn_10_weighted_unit FROM k GROUP BY 1)")
PRICED_NAMES = ("knn_5_median_unit", "knn_10_median_unit", "knn_20_median_unit", "knn_5_mean_unit", "knn_10_mean_unit", "knn_10_weighted_unit")


@query("geo_target_features", RANKED.format(on="b.fold <> 1") + PRICED + ", m AS (SELECT quantile_cont(unit, 0.5) AS m FROM p WHERE fold <> 1) SELECT p.listing_id, " + ", ".join(f"round(coalesce({c}, m), 4) AS {c}" for c in PRICED_NAMES) + " FROM p LEFT JOIN g ON p.listing_id = g.listing_id CROSS JOIN m")
def _(spark, sf):
    df = places(spark, sf)
    return rounded(geo.geo_target_features(df, df.where("fold <> 1"), "unit").select("listing_id", *PRICED_NAMES))


@query("geo_target_oof", RANKED.format(on="b.fold <> a.fold") + PRICED + ", m AS (SELECT o.k AS fold, quantile_cont(unit, 0.5) AS m FROM p JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) o ON p.fold <> o.k GROUP BY 1) SELECT p.listing_id, " + ", ".join(f"round(coalesce({c}, m), 4) AS {c}" for c in PRICED_NAMES) + " FROM p LEFT JOIN g ON p.listing_id = g.listing_id JOIN m ON m.fold = p.fold")
def _(spark, sf):
    return rounded(geo.geo_target_oof(places(spark, sf), "unit").select("listing_id", *PRICED_NAMES))


# --- round trips -----------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """Folder for a round trip, beside the other intermediate tables."""
    return f"{shared_folder(spark).rstrip('/')}/roundtrip-{uuid.uuid4().hex}"


@query("io_csv_round_trip", "SELECT count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT doc_id) AS ids, 0::BIGINT AS first_seq, count(*) - 1 AS last_seq, count(*) AS distinct_seq FROM documents")
def _(spark, sf):
    path = scratch(spark) + "/csv"
    tables.write_table(table(spark, sf, "documents").select("doc_id", "text", "lang"), path, "csv")
    back = tables.read_listings(spark, path)
    return back.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"), F.count_distinct("doc_id").alias("ids"),
        F.min("row_seq").alias("first_seq"), F.max("row_seq").alias("last_seq"), F.count_distinct("row_seq").alias("distinct_seq"))


@query("io_projected_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return tables.read_columns(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("io_json_report", with_scored("SELECT model, count(*) AS n, CAST(NULL AS DOUBLE) AS undefined FROM scored GROUP BY 1"))
def _(spark, sf):
    path = scratch(spark) + "/json"
    rep = report(spark, sf, "model").select("model", "n", (F.lit(float("inf")) * F.col("rmse")).alias("undefined"))
    tables.write_report_json(rep, path)
    return spark.read.schema("model string, n long, undefined double").json(path)


@query("io_fingerprint", "SELECT count(*) AS rows, 1 AS order_independent, 1 AS detects_change FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders")
    one = tables.table_fingerprint(df)
    shuffled = tables.table_fingerprint(df.repartition(7)).select(F.col("hash_xor").alias("x"), F.col("hash_sum").alias("s"))
    changed = tables.table_fingerprint(df.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice")))).select(F.col("hash_xor").alias("cx"))
    return one.crossJoin(shuffled).crossJoin(changed).select(
        "rows", ((F.col("hash_xor") == F.col("x")) & (F.col("hash_sum") == F.col("s"))).cast("int").alias("order_independent"),
        (F.col("hash_xor") != F.col("cx")).cast("int").alias("detects_change"))
