"""Fixtures and leakage tests of encoders, folds, bootstrap, audit and scoring."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.functions.numeric import from_target, haversine_km, to_target
from terrace.operators import audit, bootstrap, encode, evaluate, folds, geo, models, quality


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_m_estimate_and_unseen(spark):
    train = frame(spark, city=["A", "A", "B"], y=[100.0, 200.0, 300.0])
    query = frame(spark, city=["A", "new"])
    out = {r["city"]: r["city_te"] for r in encode.target_encode_m(train, query, "city", "y", 2.0).collect()}
    assert out["A"] == pytest.approx(175.0) and out["new"] == pytest.approx(200.0)
    counts = {r["city"]: (r["city_count"], r["city_log_count"]) for r in encode.count_encode(train, query, "city").collect()}
    assert counts["A"][0] == 2 and counts["new"] == (0, 0.0)


@pytest.mark.parametrize("kind", ["m", "auto"])
def test_own_target_never_enters_its_encoding(spark, kind):
    building, fold, y = ["A", "A", "B", "B", "C", "C"], [1, 2, 3, 4, 5, 1], [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]

    def run(values):
        df = spark.createDataFrame(list(zip(range(6), building, fold, values)), "i int, b string, fold int, y double")
        out = encode.target_encode_oof(df, "b", "y", 10.0) if kind == "m" else encode.target_encode_auto_oof(df, "b", "y")
        return {r["i"]: r["b_te"] for r in out.collect()}

    base = run(y)
    for row in (0, 3):
        moved = run([v + 1e6 if i == row else v for i, v in enumerate(y)])
        assert moved[row] == pytest.approx(base[row], abs=1e-9)
        assert any(abs(moved[i] - base[i]) > 1 for i in range(6) if i != row)


def test_market_oof_ignores_own_fold(spark):
    keys = dict(state=["s"] * 6, city=["c", "c", "d", "d", "c", "d"], property_type=["t"] * 6, building_name=list("aabbcc"), developer=["x"] * 6)
    base = pd.DataFrame({"i": range(6), "fold": [1, 2, 3, 4, 5, 1], "unit": [1.0, 2, 3, 4, 5, 6], **keys})
    changed = base.assign(unit=[1e6, 2, 3, 4, 5, 6])
    a, b = (encode.micro_market_oof(spark.createDataFrame(x), "unit").toPandas().set_index("i") for x in (base, changed))
    columns = [c for c in a.columns if c.startswith("micro_")]
    assert np.allclose(a.loc[0, columns].astype(float), b.loc[0, columns].astype(float))
    assert not np.allclose(a.loc[1, columns].astype(float), b.loc[1, columns].astype(float))


def test_context_fixture(spark):
    train = frame(spark, city=["A", "A", "B"], size=[100.0, 300.0, 500.0], bedroom=[1.0, 2.0, 3.0], bathroom=[1.0, 1.0, 2.0])
    query = frame(spark, city=["A", "none"], size=[100.0, 300.0], bedroom=[1.0, 1.0], bathroom=[1.0, 1.0])
    out = {r["city"]: r for r in encode.context_stats(train, query, "city", "size").collect()}
    assert (out["A"]["place_median_size"], out["A"]["place_count"]) == (200.0, 2)
    assert (out["none"]["place_median_size"], out["none"]["place_count"]) == (300.0, 0)


def test_trim_thresholds_come_from_training_rows(spark):
    price, fold = [float(i) for i in range(1, 101)], [i % 5 + 1 for i in range(100)]
    base = spark.createDataFrame(list(zip(price, fold)), "price double, fold int")
    moved = spark.createDataFrame([(p * 1000 if f == 1 else p, f) for p, f in zip(price, fold)], "price double, fold int")
    pick = lambda df: {r["trim_level"]: r["cutoff"] for r in folds.tail_trim_cutoffs(df, "price").where("fold = 1").collect()}
    assert pick(base) == pick(moved)
    with pytest.raises(ValueError):
        folds.check_winsor(0.9, 0.1)


def test_distances(spark):
    df = frame(spark, a=[0.0], b=[0.0])
    one = df.select(haversine_km(F.col("a"), F.col("b"), F.lit(0.0), F.lit(1.0)).alias("d"), haversine_km(F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("z")).first()
    assert one["d"] == pytest.approx(111.195, abs=0.01) and one["z"] == 0.0
    points = frame(spark, listing_id=[1, 2, 3], lat=[3.0, 3.0, 3.01], lon=[101.0, 101.0, 101.01])
    near = {r["listing_id"]: r["nearest_km"] for r in geo.geo_features(points).collect()}
    assert near[1] == 0.0 and near[2] == 0.0 and near[3] > 0


def test_priced_neighbours(spark):
    df = frame(spark, listing_id=[1, 2, 3], lat=[3.0, 3.1, 3.2], lon=[101.0, 101.0, 101.0], unit=[100.0, 200.0, 300.0])
    out = {r["listing_id"]: r["knn_5_mean_unit"] for r in geo.geo_target_features(df, df, "unit", exclude_self=True).collect()}
    assert out == {1: 250.0, 2: 200.0, 3: 150.0}
    bad = spark.createDataFrame([(9, None, None)], "listing_id long, lat double, lon double")
    train = frame(spark, listing_id=[1, 2, 3], lat=[3.0, 3.1, 3.2], lon=[101.0, 101.0, 101.0], unit=[100.0, 200.0, 500.0])
    row = geo.geo_target_features(bad, train, "unit").first()
    assert {row[c] for c in row.asDict() if c.startswith("knn_")} == {200.0}


@pytest.mark.parametrize("strategy", ["unit", "direct", "log_unit", "log_price", "boxcox"])
def test_targets_invert(spark, strategy):
    df = frame(spark, p=[1234.5], s=[10.0])
    lam = 0.3 if strategy == "boxcox" else None
    value = to_target(strategy, F.col("p"), F.col("s"), lam)
    assert df.select(from_target(strategy, value, F.col("s"), lam)).first()[0] == pytest.approx(1234.5)


def test_bootstrap_is_partition_free_and_sane(spark):
    rng = np.random.default_rng(0)
    n = 2000
    actual = rng.normal(100, 20, n)
    df = frame(spark, i=np.arange(n), actual=actual, candidate=actual + rng.normal(0, 5, n), reference=actual + rng.normal(0, 9, n), is_tail=(actual > 130).astype(int))
    a, b = (bootstrap.paired_bootstrap(df.repartition(k), "i", draws=200).first() for k in (2, 5))
    assert a["rmse_ci_lower"] == pytest.approx(b["rmse_ci_lower"], rel=1e-9)
    assert a["rmse_ci_lower"] < a["rmse_difference"] < a["rmse_ci_upper"] < 0
    assert a["rmse_zero_inside"] == 0 and a["rmse_p_better"] == 1.0
    weights = bootstrap.poisson_weights(np.arange(20000), np.arange(4), 1)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05


def test_audit_rules(spark):
    columns = "listing_id long, row_seq long, price double, property_size_sqft double, bedroom double, bathroom double, parking_lot double, completion_year double, number_of_floors double, total_units double, property_type string, description string"
    ok = (500000.0, 1000.0, 3.0, 2.0, 1.0, 2010.0, 20.0, 300.0, "Flat", "fine")
    rows = [(1, 1, *ok), (2, 2, *ok), (3, 3, None, *ok[1:]), (4, 4, 400000.0, 900.0, 25.0, *ok[3:]), (5, 5, 410000.0, 800.0, 3.0, 2.0, 6.0, *ok[5:]), (6, 6, 420000.0, 1000.0, *ok[2:9], "size 700 sqft")]
    out = {r["listing_id"]: r for r in audit.validity_audit(spark.createDataFrame(rows, columns)).collect()}
    assert out[1]["validity_status"] == "SUSPICIOUS" and "POSSIBLE_REPEAT_DIFFERENT_LISTING_ID" in out[1]["rules_fired"]
    assert out[3]["validity_status"] == "CLEARLY_INVALID" and out[4]["rules_fired"] == ["IMPOSSIBLE_CORE_COUNT"]
    assert out[5]["rules_fired"] == ["UNSUPPORTED_HIGH_PARKING_COUNT"] and out[6]["rules_fired"] == ["SINGLE_DESCRIPTION_SIZE_MISMATCH"]


def test_expectations_raise(spark):
    df = frame(spark, k=[1, 1, 2], fold=[1, 2, 1], price=[1.0, -1.0, 2.0])
    for call in (
        lambda: quality.expect_unique(df, ["k"]), lambda: quality.expect_row_count(df, 4), lambda: quality.require_columns(df, ["zz"]),
        lambda: quality.expect_partition(df, "k", "fold", 2), lambda: quality.expect_positive_finite(df, ["price"]),
        lambda: quality.validate_prepared(df, "price", ["price"], ["k"]),
    ):
        with pytest.raises(quality.ExpectationError):
            call()


def test_unusable_predictions_stay_unavailable(spark):
    df = frame(spark, v=[5.0, -1.0, float("inf"), float("nan")], s=[2.0] * 4)
    rows = models.with_status(df, F.col("v"), F.col("s")).collect()
    assert [r["status"] for r in rows] == ["available"] + ["unavailable"] * 3
    assert [r["predicted_total"] for r in rows] == [5.0, None, None, None]


def test_fit_learns_and_blend_weights_sum_to_one(spark):
    rng = np.random.default_rng(3)
    size, rooms = rng.integers(500, 1500, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    city = rng.choice(["a", "b"], 300)
    price = size * (300 + 40 * rooms + np.where(city == "a", 100, 0))
    df = frame(spark, listing_id=np.arange(300), price=price, property_size_sqft=size, rooms=rooms, city=city)
    df = folds.assign_group_kfold(df, "listing_id", 3)
    spec = models.Spec("ridge", "ridge", ("property_size_sqft", "rooms"), ("city",), (("regParam", 1e-6),))
    scored = models.oof_predict(df, [spec], folds=3)
    assert scored.count() == 300
    assert evaluate.regression_metrics(scored, ["model"]).first()["r2"] > 0.99
    wide = scored.select(F.col("actual"), F.col("predicted").alias("x"), (F.col("predicted") * 1.2).alias("y"))
    weights = models.blend_weights(wide, ["x", "y"])
    assert sum(weights.values()) == pytest.approx(1.0) and min(weights.values()) >= 0


def test_market_columns_are_written_and_need_no_join_of_their_rows(spark):
    rows = [(i, "s" if i % 2 else None, f"c{i % 3}", "t", "b", None, float(i), i % 5 + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, state string, city string, property_type string, building_name string, developer string, unit double, fold int")
    out = encode.micro_market_oof(df, "unit")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    first = {r.id: r for r in out.collect()}[0]
    # Row 0 learns from the other folds' rows of its state (none given), that is from the even ids outside fold 1.
    others = [r[6] for r in rows if r[1] is None and r[7] != 1]
    assert first.micro_state_count == len(others) and first.micro_state_mean == pytest.approx(sum(others) / len(others))
