"""Cross-fitting from one table, moment-matrix ridge, stacks, saved bundles, expert systems, resumable tuning."""

import json
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import bundle, crossfit, experts, models
from terrace.operators.encode import target_encode_auto, target_encode_auto_oof
from terrace.operators.folds import hash_fold

SCHEMA = "listing_id string, fold int, price double, property_size_sqft double, bedroom double, kind string, place string"


def market(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size, kind, place = float(rng.integers(400, 2000)), str(rng.choice(["a", "b", "c"])), str(rng.choice(["x", "y"]))
        unit = {"a": 3.0, "b": 5.0, "c": 8.0}[kind] + (place == "y") + 0.1 * rng.standard_normal()
        bedroom = None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(rng.integers(1, 5))
        rows.append((f"id{i}", i % 5 + 1, float(unit * size), size, bedroom, None if i % 23 == 0 else kind, place))
    return spark.createDataFrame(rows, SCHEMA)


SPEC = models.Spec("ridge", "ridge", ("property_size_sqft", "bedroom"), ("kind", "place"), (("regParam", 0.01),))


def unit():
    return F.col("price") / F.col("property_size_sqft")


def test_encodings_of_all_folds_equal_those_of_each_job(spark):
    df = market(spark)
    encoded = crossfit.encode_folds(df, SPEC.numeric, SPEC.categorical, unit(), "listing_id")
    for k in (1, 4):
        y = df.withColumn("_y", unit())
        train, held = y.where(F.col("fold") != k), y.where(F.col("fold") == k)
        folded = train.withColumn("_inner", hash_fold(F.col("listing_id"), crossfit.INNER, crossfit.INNER_SEED))
        want = {r.listing_id: r.kind_te for r in target_encode_auto_oof(folded, "kind", "_y", "_inner").collect()}
        want |= {r.listing_id: r.kind_te for r in target_encode_auto(train, held, "kind", "_y").collect()}
        got = {r.listing_id: r.kind_te for r in encoded.view(k).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)
        middle = np.median([r.bedroom for r in train.collect() if r.bedroom is not None and not math.isnan(r.bedroom)])
        assert encoded.medians[k - 1]["bedroom"] == middle


def test_a_rows_own_target_stays_out_of_its_encodings(spark):
    df = market(spark)
    changed = df.withColumn("price", F.when(F.col("listing_id") == "id7", F.lit(1e12)).otherwise(F.col("price")))
    before, after = ({r.listing_id: r for r in crossfit.encode_folds(d, SPEC.numeric, SPEC.categorical, unit(), "listing_id").data.collect()} for d in (df, changed))
    assert before["id7"]._te_kind[before["id7"].fold - 1] == after["id7"]._te_kind[after["id7"].fold - 1]
    for k in range(5):
        assert math.isclose(before["id7"]._te_kind[k], after["id7"]._te_kind[k], rel_tol=1e-12)


def test_ridge_from_moments_equals_normal_equations(spark):
    df = market(spark)
    encoded = crossfit.encode_folds(df, SPEC.numeric, SPEC.categorical, unit(), "listing_id")
    got = crossfit.ridge_models(encoded, {"r": 0.01})["r"]
    scored = {r.listing_id: r.predicted for r in models.oof_predict(df, [SPEC]).collect()}
    assert len(scored) == 240
    for k in range(1, 6):
        train = encoded.train(k).select(*encoded.features, "_y").toPandas().to_numpy()
        x, y = train[:, :-1], train[:, -1]
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
        w = np.linalg.solve(z.T @ z + 0.01 * len(z) * np.eye(z.shape[1]), z.T @ (y - y.mean())) / x.std(axis=0, ddof=1)
        assert np.allclose(got[k - 1].weights, w, rtol=1e-8) and math.isclose(got[k - 1].intercept, y.mean() - w @ x.mean(axis=0), rel_tol=1e-8)
        for r in encoded.held(k).collect():
            value = (y.mean() + (np.array([r[c] for c in encoded.features]) - x.mean(axis=0)) @ w) * r._orig_property_size_sqft
            assert math.isclose(scored[r.listing_id], max(value, 0.0), rel_tol=1e-8)


def test_moments_of_odd_tables(spark):
    flat = np.array([[4.0, 8.0, 12.0], [8.0, 16.0, 24.0], [12.0, 24.0, 36.0]])
    # A column without spread gets no weight; no rows give a model that says 0.
    assert crossfit.ridge_from_moments(flat, 0.1).weights == (0.0,)
    assert crossfit.ridge_from_moments(np.zeros((4, 4)), 1.0).weights == (0.0, 0.0)
    empty = spark.createDataFrame([], "a double, b double")
    assert crossfit.moments(empty, ["a", "b"], F.array(F.lit(0))) == {}


def test_nested_stack_against_numpy(spark):
    rng = np.random.default_rng(8)
    n = 300
    actual = rng.normal(100, 20, n)
    p = np.column_stack([actual + rng.normal(0, s, n) for s in (5, 8, 12)])
    rows = [(f"r{i}", i % 5 + 1, float(actual[i]), *map(float, p[i])) for i in range(n)] + [("gap", 1, 90.0, None, 1.0, 2.0)]
    wide = spark.createDataFrame(rows, "listing_id string, fold int, actual double, m1 double, m2 double, m3 double")
    stacked, report = crossfit.nested_stack(wide, ["m1", "m2", "m3"], "listing_id")
    part = {r.listing_id: r.part for r in wide.select("listing_id", (hash_fold(F.col("listing_id"), 4, 99) - 1).alias("part")).collect()}
    fold, parts = np.arange(n) % 5 + 1, np.array([part[f"r{i}"] for i in range(n)])

    def ridge(x, y, a):
        c = x - x.mean(axis=0)
        w = np.linalg.solve(c.T @ c + a * np.eye(x.shape[1]), c.T @ (y - y.mean()))
        return w, y.mean() - w @ x.mean(axis=0)

    chosen, rmse = {}, {}
    for k in range(1, 6):
        out = fold != k
        for a in crossfit.STACK_ALPHAS:
            total = 0.0
            for j in range(4):
                w, b = ridge(p[out & (parts != j)], actual[out & (parts != j)], a)
                total += ((p[out & (parts == j)] @ w + b - actual[out & (parts == j)]) ** 2).sum()
            rmse[k, a] = math.sqrt(total / out.sum())
        least = min(rmse[k, a] for a in crossfit.STACK_ALPHAS)
        chosen[k] = min(a for a in crossfit.STACK_ALPHAS if rmse[k, a] <= least * (1 + crossfit.SAME))
    for r in report.collect():
        assert math.isclose(r.rmse, rmse[r.fold, r.alpha], rel_tol=1e-8) and r.chosen == int(chosen[r.fold] == r.alpha)
    for r in stacked.collect():
        if r.listing_id == "gap":
            assert r.stacked is None
            continue
        w, b = ridge(p[fold != r.fold], actual[fold != r.fold], chosen[r.fold])
        assert math.isclose(r.stacked, p[int(r.listing_id[1:])] @ w + b, rel_tol=1e-8)


def test_tuning_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    df = market(spark)
    base = models.Spec("base", "ridge", ("property_size_sqft", "bedroom"), ("kind",), (("regParam", 0.01),))
    forest = models.Spec("f", "random_forest", base.numeric, base.categorical, (("maxDepth", 3), ("numTrees", 3)))
    candidates = {"base": base, "weak": models.replace(base, params=(("regParam", 10.0),)), "twin": base, "forest": forest}
    fits = []
    real = models.fit_pipeline
    monkeypatch.setattr(models, "fit_pipeline", lambda data, spec: (fits.append(spec.name), real(data, spec))[1])
    first = models.tune(df, candidates, results=str(tmp_path / "tuning")).collect()
    assert len(fits) == 5 and {r.candidate for r in first} == {"base", "weak", "forest"} and all(r.n == 240 for r in first)
    again = models.tune(df, candidates | {"weaker": models.replace(base, params=(("regParam", 50.0),))}, results=str(tmp_path / "tuning")).collect()
    assert len(fits) == 5 and len(again) == 4
    plain = {r.candidate: r.rmse for r in first}
    assert all(math.isclose(plain[r.candidate], r.rmse, rel_tol=1e-9) for r in again if r.candidate in plain)
    oof = models.oof_predict(df, [base]).selectExpr("sqrt(avg(pow(predicted - actual, 2))) AS rmse").first().rmse
    assert math.isclose(plain["base"], oof, rel_tol=1e-9) and plain["base"] < plain["weak"]


RAW = "listing_id string, price double, property_size_sqft string, bedroom string, bathroom string, parking_lot string, completion_year string, number_of_floors string, total_units string, property_type string, state string, city string, building_name string, developer string, tenure_type string, description string, note string"


def raw(spark, n=120):
    rng = np.random.default_rng(5)
    texts = ["Spacious high floor top floor home with a large balcony", "", None, "Low  floor", "nothing to see"]
    rows = [
        (f"id{i}", float(300_000 + 500 * rng.integers(0, 400)), str(500 + 10 * (i % 40)), str(1 + i % 4), "2", str(i % 3), str(1990 + i % 30) if i % 7 else None, "20", "300",
         ["Condo", "Flat"][i % 2], "S", ["C1", "C2"][i % 2], f"B{i % 6}", f"D{i % 4}", "Freehold", texts[i % 5], "kept")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, RAW)


def numbers(df):
    return df.withColumns({c: F.col(c).cast("double") for c in bundle.BASE_NUMERIC})


@pytest.fixture(scope="module")
def trained(spark):
    return bundle.fit_bundle(numbers(raw(spark)), bundle.text_spec("boosting", "gradient_boosting", (("maxDepth", 2), ("maxIter", 3))))


def test_bundle_scores_raw_rows(spark, trained):
    length = len("spacious high floor top floor home with a large balcony")
    lengths = [length, 9, 14] * 24
    assert trained.rows == 120 and trained.length_median == float(np.median(lengths))
    good = raw(spark, 5).drop("price")
    bad = [
        ("zero", "0", "1", "1", "1", "2000"), ("text", "n/a", "1", "1", "1", "2000"), ("minus", "900", "-1", "1", "1", "2000"), ("gap", "900", None, "1", "1", "2000"),
        ("year", "900", "1", "1", "1", "1700"), ("inf", "Infinity", "1", "NaN", "1", "2000"), ("fine", "900", "0", "0", "0", "  "),
    ]
    broken = spark.createDataFrame(bad, "listing_id string, property_size_sqft string, bedroom string, bathroom string, parking_lot string, completion_year string").withColumns(
        {c: F.lit("Never Seen 999" if c in bundle.NAMES else None).cast("string") for c in good.columns if c not in ("listing_id", "property_size_sqft", "bedroom", "bathroom", "parking_lot", "completion_year")})
    got = {r.listing_id: r for r in bundle.score_raw(good.unionByName(broken), trained).collect()}
    assert len(got) == 12 and got["id0"].note == "kept" and got["id0"].property_size_sqft == "500"
    assert got["id0"].detected == ["is_high_floor_text", "is_top_floor_text", "has_balcony", "has_large_balcony"] and got["id3"].detected == ["is_low_floor_text"]
    assert got["id1"].description_length == got["id2"].description_length == trained.length_median and got["id1"].detected == []
    for i in ("id0", "id1", "fine"):
        assert got[i].status == "available" and got[i].errors == [] and math.isclose(got[i].predicted_total, got[i].predicted_unit * float(got[i].property_size_sqft))
    said = {
        "zero": ["property_size_sqft must be greater than zero"], "text": ["property_size_sqft must be a finite number"], "minus": ["bedroom cannot be negative"],
        "gap": ["bedroom must be a finite number"], "year": ["completion_year must be between 1800 and 2030"],
        "inf": ["property_size_sqft must be a finite number", "bathroom must be a finite number"],
    }
    for i, errors in said.items():
        assert got[i].errors == errors and got[i].status == "unavailable" and got[i].predicted_total is None and got[i].predicted_unit is None
    with pytest.raises(ValueError, match="names"):
        bundle.score_raw(good.withColumn("status", F.lit(1)), trained)
    assert bundle.score_raw(good.limit(0), trained).count() == 0
    with pytest.raises(ValueError, match="training rows"):
        bundle.fit_bundle(numbers(raw(spark)).withColumn("price", F.when(F.col("listing_id") == "id3", 0.0).otherwise(F.col("price"))), trained.fitted.spec)


READER = """
import json, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from terrace.operators import bundle
scored = bundle.score_raw(spark.read.parquet({rows!r}), bundle.load_bundle(spark, {path!r}))
print("SCORES" + json.dumps({{r.listing_id: r.predicted_total for r in scored.collect()}}))
"""


def test_bundle_is_read_in_another_session(spark, trained, tmp_path):
    path, rows = str(tmp_path / "bundle"), str(tmp_path / "rows")
    bundle.save_bundle(trained, path)
    good = raw(spark, 20).drop("price")
    good.write.parquet(rows)
    code = READER.format(repo=os.path.join(os.path.dirname(__file__), ".."), rows=rows, path=path)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    found = json.loads(next(line for line in out.stdout.splitlines() if line.startswith("SCORES"))[6:])
    want = {r.listing_id: r.predicted_total for r in bundle.score_raw(good, trained).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[i], want[i], rel_tol=1e-12) for i in want)


def test_expert_systems_recompute(spark):
    df = bundle.listing_features(numbers(raw(spark, 200)).withColumn("fold", F.expr("CAST(substr(listing_id, 3) AS INT) % 2 + 1")), "description")
    spec = models.Spec("expert", "ridge", ("property_size_sqft", "bedroom"), ("city", "building_name"))
    params = {"random_forest": (("maxDepth", 2), ("numTrees", 2)), "gradient_boosting": (("maxDepth", 2), ("maxIter", 2)), "ridge": (("regParam", 0.01),)}
    names = ("hard_rf_lgbm_p20", "soft_rf_lgbm_direct_p15", "soft_rf_below_lgbm_p15", "soft_rf_ridge_p15", "soft_rf_lgbm_p15_calibrated", "soft_rf_lgbm_p15_description")
    rows = experts.expert_systems(df, spec, params, {"maxIter": 2, "maxDepth": 2}, {n: experts.SYSTEMS[n] for n in names}, folds=2, inner=2).collect()
    assert len(rows) == 200 * len(names) and len({(r.system, r.listing_id) for r in rows}) == len(rows)
    for r in rows:
        assert 0 <= r.probability <= 1 and r.standard > 0 and r.premium > 0
        route = (r.premium if r.probability >= r.threshold else r.standard) if r.system.startswith("hard") else (1 - r.probability) * r.standard + r.probability * r.premium
        assert math.isclose(r.predicted, route, rel_tol=1e-9)
    # Within a fold the calibrated probability follows the plain one.
    for k in (1, 2):
        plain, sure = ({r.listing_id: r.probability for r in rows if r.system == s and r.fold == k} for s in ("soft_rf_ridge_p15", "soft_rf_lgbm_p15_calibrated"))
        order = sorted(plain, key=plain.get)
        steps = [sure[b] - sure[a] for a, b in zip(order, order[1:])]
        assert all(d >= -1e-12 for d in steps) or all(d <= 1e-12 for d in steps)
    assert len(experts.SYSTEMS) == 14 and {e for s in experts.SYSTEMS.values() for e in (s.standard, s.premium)} == set(experts.EXPERTS)


def test_bootstrap_intervals_against_numpy(spark):
    """5,000 draws; the same weights in one NumPy run give the same intervals."""
    from terrace.operators import bootstrap

    rng = np.random.default_rng(6)
    actual = rng.normal(100, 15, 250)
    rows = [(f"k{i}", ref, float(actual[i]), float(actual[i] + e), float(actual[i] + f), int(actual[i] > 115))
            for i, (e, f, h) in enumerate(rng.normal(0, (4, 5, 6), (250, 3))) for ref, f in (("x", f), ("y", h))]
    df = spark.createDataFrame(rows, "listing_id string, reference_model string, actual double, candidate double, reference double, is_tail int")
    got = {r.reference_model: r for r in bootstrap.paired_bootstrap(df.repartition(5), "listing_id", ["reference_model"]).collect()}
    keys = {r.listing_id: r.k for r in df.select("listing_id", F.xxhash64("listing_id").alias("k")).collect()}
    for ref, one in got.items():
        some = [r for r in rows if r[1] == ref]
        w = bootstrap.poisson_weights(np.array([keys[r[0]] for r in some]), np.arange(5000), 42)
        c, f = (np.array([r[j] - r[2] for r in some]) for j in (3, 4))
        tail = np.array([r[5] for r in some], dtype=float)
        root = lambda e, v: np.sqrt((v * w.T) @ (e * e) / (v * w.T).sum(axis=1))
        draws = {"rmse": root(c, 1.0) - root(f, 1.0), "mae": w.T @ (np.abs(c) - np.abs(f)) / w.sum(axis=0), "tail": root(c, tail) - root(f, tail)}
        assert one.draws == 5000
        for name, d in draws.items():
            low, middle, high = np.percentile(d, [2.5, 50, 97.5])
            assert np.allclose([one[f"{name}_ci_lower"], one[f"{name}_median_difference"], one[f"{name}_ci_upper"]], [low, middle, high], rtol=1e-8, atol=1e-10)
            assert math.isclose(one[f"{name}_p_better"], (d < 0).mean(), abs_tol=1e-12)
    many = bootstrap.poisson_weights(np.arange(20000), np.arange(3, 13), 1)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.03
    assert (many[:, 2:5] == bootstrap.poisson_weights(np.arange(20000), np.arange(5, 8), 1)).all()
