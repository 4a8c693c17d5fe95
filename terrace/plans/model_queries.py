"""Distributed fits and text vectors over whole tables.

Fits have no SQL equivalent; text statistics do.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import bundle, crossfit, evaluate, experts, folds, models, quality, textvec
from terrace.plans.model_sql import SQL_DESCRIBED, SQL_DETECTED, SQL_RAW, raw_rows, sql_features, sql_ridge, sql_stack
from terrace.plans.registry import query, rounded, sql_fold, with_listings, with_scored
from terrace.session import durable, shared_folder
from terrace.sources.surrogate import MODELS, described, listings, scored, table

NUMERIC = ("property_size_sqft", "bedroom", "bathroom", "parking_lot", "completion_year", "number_of_floors", "total_units")
CATEGORICAL = ("property_type", "state", "city", "building_name", "developer")
SMALL_TREES = (("maxBins", 32), ("maxDepth", 4), ("numTrees", 8))
SMALL_BOOST = (("maxBins", 32), ("maxDepth", 3), ("maxIter", 5))


def spec(name: str, family: str, params=(), target: str = "unit", categorical=CATEGORICAL[:2]) -> models.Spec:
    return models.Spec(name, family, NUMERIC, tuple(categorical), tuple(params), target)


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with folds, for jobs that write what they read of them themselves."""
    df = listings(spark, sf, ["listing_id", "price", "tenure_type", *NUMERIC, *CATEGORICAL])
    return folds.assign_group_kfold(df, "listing_id")


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return durable(folded(spark, sf))


@query("model_oof_ridge")
def _(spark, sf):
    return models.oof_predict(folded(spark, sf), [spec("ridge", "ridge", (("regParam", 0.001),))], folds=5)


@query("model_oof_coverage", with_listings(
    "SELECT 'ridge' AS model, count(*) AS ids, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS non_finite, CAST(0 AS BIGINT) AS foreign_ids, CAST(0 AS BIGINT) AS unscored FROM listings"))
def _(spark, sf):
    """Rows whose features are missing or not numbers are scored like all others."""
    df = prepared(spark, sf).withColumn("total_units", F.when(F.hash("listing_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("total_units")))
    df = df.withColumn("bedroom", F.when(F.hash("listing_id") % 5 != 0, F.col("bedroom")))
    scored = models.oof_predict(df, [spec("ridge", "ridge", (("regParam", 0.001),))], folds=5)
    return quality.oof_coverage(scored, "listing_id", df)


@query("model_oof_forest")
def _(spark, sf):
    scored = models.oof_predict(folded(spark, sf), [spec("forest", "random_forest", SMALL_TREES, categorical=CATEGORICAL)], folds=5)
    return evaluate.regression_metrics(scored, ["model"])


@query("model_oof_boosting")
def _(spark, sf):
    scored = models.oof_predict(folded(spark, sf), [spec("boosting", "gradient_boosting", SMALL_BOOST, categorical=CATEGORICAL)], folds=5)
    return evaluate.regression_metrics(scored, ["model"])


RIDGE_SQL = with_listings(sql_ridge(NUMERIC, CATEGORICAL[:2], 0.001))


@query("model_ridge_coefficients", RIDGE_SQL + " SELECT fold, feature, round(coefficient, 3) AS coefficient FROM coefficients")
def _(spark, sf):
    """One ridge a fold, solved from moment matrices."""
    encoded = crossfit.encode_folds(prepared(spark, sf), NUMERIC, CATEGORICAL[:2], F.expr("CAST(price AS DOUBLE) / CAST(property_size_sqft AS DOUBLE)"), "listing_id")
    return rounded(crossfit.coefficients(encoded, crossfit.ridge_models(encoded, {"ridge": 0.001})["ridge"]), 3)


@query("model_ridge_fold_errors", RIDGE_SQL + """, held AS (SELECT r.*, j.k FROM ready r JOIN (SELECT DISTINCT k FROM jobs) j ON r.fold = j.k),
 placed AS (""" + sql_features(NUMERIC, CATEGORICAL[:2], "held", "0") + """),
 priced AS (SELECT k, row_id, price, greatest(size * sum(coefficient * v), 0.0) AS predicted FROM placed JOIN coefficients ON fold = k AND feature = name GROUP BY k, row_id, price, size)
 SELECT 'ridge' AS model, k AS fold, count(*) AS n, round(sqrt(avg((predicted - price) * (predicted - price))), 2) AS rmse, round(avg(abs(predicted - price)), 2) AS mae FROM priced GROUP BY k""")
def _(spark, sf):
    scored = models.oof_predict(folded(spark, sf), [spec("ridge", "ridge", (("regParam", 0.001),))], folds=5)
    e = F.col("predicted") - F.col("actual")
    return rounded(scored.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")), 2)


#: The baseline and 30 penalties, evenly in the exponent.
RIDGE_GRID = {"baseline": 0.001, **{f"ridge_{i:02d}": 10.0 ** (-5 + i / 5) for i in range(30)}}


@query("model_tune")
def _(spark, sf):
    """31 ridge penalties on all categories from one pass, forests and boosting as jobs side by side."""
    base = spec("baseline", "ridge", categorical=CATEGORICAL)
    candidates = {name: replace(base, params=(("regParam", r),)) for name, r in RIDGE_GRID.items()}
    candidates["same_as_baseline"] = candidates["baseline"]
    for depth in (3, 5):
        candidates[f"forest_{depth}"] = spec("f", "random_forest", (("maxBins", 32), ("maxDepth", depth), ("numTrees", 8)), categorical=CATEGORICAL)
        candidates[f"boosting_{depth}"] = spec("b", "gradient_boosting", (("maxBins", 32), ("maxDepth", depth), ("maxIter", 5)), categorical=CATEGORICAL)
    return models.tune(folded(spark, sf), candidates, folds=5)


@query("model_nested_tune")
def _(spark, sf):
    base = spec("baseline", "ridge", categorical=CATEGORICAL)
    scored, _ = models.nested_tune(prepared(spark, sf), {name: replace(base, params=(("regParam", r),)) for name, r in RIDGE_GRID.items()}, folds=5, inner=3)
    return scored


@query("model_scope_scoring")
def _(spark, sf):
    df = prepared(spark, sf)
    fitted = models.fit_on_scope(df, spec("ridge", "ridge", (("regParam", 0.001),)), 80000.0)
    return models.score_batch(df, fitted).select("listing_id", "status", "predicted_total", "predicted_unit")


def text_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with descriptions and folds, written once."""
    return durable(folds.assign_group_kfold(described(spark, sf, [*bundle.BASE_NUMERIC, *bundle.BASE_CATEGORICAL]), "listing_id"))


@query("model_text_boosting", with_listings(
    f"SELECT 'boosting_text' AS model, {sql_fold('listing_id', 5, 42)} AS fold, count(*) AS n, count(*) AS finite_predictions, TRUE AS better_than_mean FROM listings GROUP BY 2"))
def _(spark, sf):
    """Boosting on structure, interactions and the five text flags: all folds, all rows, and less than half of the squared unit-price error that the training mean has."""
    df = bundle.listing_features(text_listings(spark, sf), "description")
    scored = durable(models.oof_predict(df, [bundle.text_spec("boosting_text", "gradient_boosting", SMALL_BOOST)], keep=("property_size_sqft",)))
    unit = F.col("actual") / F.col("property_size_sqft")
    totals = scored.groupBy("fold").agg(F.sum(unit).alias("s"), F.count(F.lit(1)).alias("c"))
    whole = totals.agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"))
    means = totals.crossJoin(F.broadcast(whole)).select("fold", ((F.col("all_s") - F.col("s")) / (F.col("all_c") - F.col("c"))).alias("mean"))
    e, m = F.col("predicted") / F.col("property_size_sqft") - unit, F.col("mean") - unit
    finite = F.count_if(F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < float("inf")))
    return scored.join(F.broadcast(means), "fold").groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"), finite.alias("finite_predictions"), (F.avg(e * e) < 0.5 * F.avg(m * m)).alias("better_than_mean"))


@query("model_batch_scoring", with_listings(f"""{SQL_DESCRIBED}, raw AS ({SQL_RAW}),
 typical AS (SELECT median(CASE WHEN description <> '' THEN CAST(length(description) AS DOUBLE) END) AS length FROM described),
 judged AS (SELECT *, list_filter([CASE WHEN size IS NULL THEN 'property_size_sqft must be a finite number' END, CASE WHEN size <= 0 THEN 'property_size_sqft must be greater than zero' END,
   CASE WHEN bedroom IS NULL THEN 'bedroom must be a finite number' END, CASE WHEN bedroom < 0 THEN 'bedroom cannot be negative' END,
   CASE WHEN completion_year NOT BETWEEN 1800 AND 2030 THEN 'completion_year must be between 1800 and 2030' END], lambda m: m IS NOT NULL) AS errors FROM raw)
 SELECT listing_id, CASE WHEN len(errors) = 0 THEN 'available' ELSE 'unavailable' END AS status, array_to_string(errors, '; ') AS errors,
  array_to_string(list_filter([{SQL_DETECTED}], lambda m: m IS NOT NULL), ',') AS detected,
  CASE WHEN description = '' THEN typical.length ELSE CAST(length(description) AS DOUBLE) END AS description_length, len(errors) = 0 AS scored FROM judged, typical"""))
def _(spark, sf):
    """Fit, save, read back, and score raw rows of which some are broken."""
    df = text_listings(spark, sf)
    trained = bundle.fit_bundle(df, bundle.text_spec("forest_text", "random_forest", SMALL_TREES))
    path = f"{shared_folder(spark).rstrip('/')}/terrace/bundle-{uuid.uuid4().hex}"
    bundle.save_bundle(trained, path)
    scored = bundle.score_raw(raw_rows(df), bundle.load_bundle(spark, path))
    return scored.select("listing_id", "status", F.array_join("errors", "; ").alias("errors"), F.array_join("detected", ",").alias("detected"), "description_length", F.col("predicted_total").isNotNull().alias("scored"))


@query("model_feature_importance")
def _(spark, sf):
    """Mean over five folds, the first 15 of each model."""
    both = [bundle.text_spec("boosting", "gradient_boosting", SMALL_BOOST), bundle.text_spec("ridge", "ridge", (("regParam", 0.001),))]
    return models.feature_importance(bundle.listing_features(text_listings(spark, sf), "description"), both)


@query("model_log_target_smeared")
def _(spark, sf):
    return models.oof_smeared(folded(spark, sf), spec("ridge_log", "ridge", (("regParam", 0.001),), "log_unit", CATEGORICAL)).select("listing_id", "fold", "actual", "predicted")


@query("model_alternative_losses")
def _(spark, sf):
    """Five Tweedie powers, Huber and absolute loss over all folds and categories; nothing ends before it has settled but by MLlib's defaults."""
    families = {f"tweedie_{p}": ("tweedie", (("variancePower", p),)) for p in (1.1, 1.3, 1.5, 1.7, 1.9)}
    families |= {"huber": ("huber", ()), "absolute": ("absolute", ())}
    scored = models.oof_predict(folded(spark, sf), [spec(name, family, params, categorical=CATEGORICAL) for name, (family, params) in families.items()])
    return evaluate.regression_metrics(scored, ["model"])


@query("model_knn_regression")
def _(spark, sf):
    """All folds, two features."""
    df = prepared(spark, sf)
    parts = []
    for k in range(1, 6):
        found = models.fit_knn_regression(df.where(F.col("fold") != k), df.where(F.col("fold") == k), ["property_size_sqft", "bedroom"], "price", "listing_id", 5, weighted=True)
        parts.append(found.select("listing_id", "fold", "price", "predicted"))
    return reduce(DataFrame.unionByName, parts)


GATE = {"maxIter": 3, "maxDepth": 3}
EXPERT_PARAMS = {"random_forest": SMALL_TREES, "gradient_boosting": SMALL_BOOST, "ridge": (("regParam", 0.001),)}


def expert_rows(spark: SparkSession, sf: str, systems=None) -> DataFrame:
    df = bundle.listing_features(text_listings(spark, sf), "description")
    return durable(experts.expert_systems(df, spec("expert", "ridge", categorical=CATEGORICAL[:2]), EXPERT_PARAMS, GATE, systems))


@query("model_premium_routing")
def _(spark, sf):
    """Hard, soft and calibrated routes of the 15 % scope over all folds."""
    names = ("hard_rf_lgbm_p15", "soft_rf_lgbm_p15", "soft_rf_lgbm_p15_calibrated")
    return expert_rows(spark, sf, {n: experts.SYSTEMS[n] for n in names})


@query("model_expert_systems", with_listings(
    "SELECT system, count(*) AS n, count(DISTINCT listing_id) AS ids, CAST(0 AS BIGINT) AS wrong_routes, CAST(0 AS BIGINT) AS outside_experts FROM listings CROSS JOIN (VALUES "
    + ", ".join(f"('{n}')" for n in experts.SYSTEMS) + ") v(system) GROUP BY system"))
def _(spark, sf):
    """All fourteen systems: rows accounted for, and every route computed again from what is stored."""
    rows = expert_rows(spark, sf)
    p, s, e = F.col("probability"), F.col("standard"), F.col("premium")
    again = F.when(F.col("threshold").isNotNull(), F.when(p >= F.col("threshold"), e).otherwise(s)).otherwise((1.0 - p) * s + p * e)
    wrong = F.coalesce(F.abs(F.col("predicted") - again) > 1e-6 * F.abs(again), F.lit(True))
    outside = ~F.coalesce(F.col("predicted").between(F.least(s, e) - 1e-6, F.greatest(s, e) + 1e-6), F.lit(False))
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("listing_id").alias("ids"), F.count_if(wrong).alias("wrong_routes"), F.count_if(outside).alias("outside_experts"))


def stack_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All four models' predictions side by side."""
    return durable(scored(spark, sf).groupBy("listing_id", "fold").agg(
        F.max("actual").alias("actual"), *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in MODELS]))


@query("model_stack")
def _(spark, sf):
    return crossfit.nested_stack(stack_rows(spark, sf), list(MODELS), "listing_id")[0].select("listing_id", "fold", "actual", "stacked")


@query("model_stack_penalties", with_scored(sql_stack(MODELS) + " SELECT fold, round(alpha, 6) AS alpha, round(rmse, 3) AS rmse, CAST(alpha = best AS INTEGER) AS chosen FROM judged JOIN picked USING (fold)"))
def _(spark, sf):
    """25 penalties in each of five outer folds, judged on four inner folds by normal equations."""
    report = crossfit.nested_stack(stack_rows(spark, sf), list(MODELS), "listing_id")[1]
    return report.select("fold", F.round("alpha", 6).alias("alpha"), F.round("rmse", 3).alias("rmse"), "chosen")


@query("model_stack_errors", with_scored(sql_stack(MODELS) + ", final AS (" + "SELECT w.fold, w.actual, " + " + ".join(["max(CASE WHEN s.i = 0 THEN s.v END)"] + [f"max(CASE WHEN s.i = {i} THEN s.v END) * w.p{i}" for i in range(1, len(MODELS) + 1)])
       + " AS stacked FROM wide w JOIN weights s ON s.fold = w.fold GROUP BY w.listing_id, w.fold, w.actual, " + ", ".join(f"w.p{i}" for i in range(1, len(MODELS) + 1))
       + ") SELECT fold, count(*) AS n, round(sqrt(avg((stacked - actual) * (stacked - actual))), 2) AS rmse FROM final GROUP BY fold"))
def _(spark, sf):
    rows = crossfit.nested_stack(stack_rows(spark, sf), list(MODELS), "listing_id")[0]
    e = F.col("stacked") - F.col("actual")
    return rounded(rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")), 2)


# --- text ------------------------------------------------------------------

ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
WORDS_SQL = (f"WITH d AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}') AS w FROM documents),"
             " g AS (SELECT doc_id, unnest(w) AS term FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM d),"
             " c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_count FROM c GROUP BY 1),"
             " k AS (SELECT *, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM v WHERE df >= 5 AND df <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total_count DESC, term LIMIT 5000)")


@query("text_vocabulary", WORDS_SQL + " SELECT term, df, total_count, round(idf, 6) AS idf FROM k")
def _(spark, sf):
    return rounded(textvec.term_stats(table(spark, sf, "documents"), "text").drop("term_index"), 6)


@query("text_tfidf", WORDS_SQL + ", x AS (SELECT doc_id, term, tf, (1 + ln(tf)) * idf AS wt FROM c JOIN k USING (term)), n AS (SELECT doc_id, sqrt(sum(wt * wt)) AS norm FROM x GROUP BY 1) SELECT doc_id, term, tf, round(wt / norm, 6) AS weight FROM x JOIN n USING (doc_id)")
def _(spark, sf):
    df = table(spark, sf, "documents")
    return rounded(textvec.tfidf_rows(df, "doc_id", "text", textvec.term_stats(df, "text")).drop("term_index"), 6)


@query("text_char_vocabulary")
def _(spark, sf):
    return rounded(textvec.term_stats(table(spark, sf, "documents"), "text", "char").drop("term_index"), 6)


@query("text_svd")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    scores, _ = textvec.text_svd(df, df, "doc_id", "text", 10)
    return scores


@query("text_svd_variance")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return textvec.text_svd(df, df, "doc_id", "text", 10)[1]


@query("text_ridge")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", F.log1p("n_chars").alias("target"))
    return models.fit_text_ridge(df.where("doc_id % 5 <> 0"), df, "doc_id", "text", "target").select("doc_id", "target", "predicted")
