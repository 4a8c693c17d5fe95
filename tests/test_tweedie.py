"""Tweedie regressions from weighted moment matrices are those of MLlib."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from terrace.operators import crossfit, models


def market(spark):
    rng = np.random.default_rng(8)
    size, rooms, kind = rng.integers(400, 2000, 400), rng.integers(1, 6, 400), rng.integers(0, 3, 400)
    unit = np.exp(1.0 + 0.2 * rooms + 0.4 * kind - size / 4000 + 0.1 * rng.standard_normal(400))
    rows = [(i, i % 5 + 1, float(u * s), float(s), None if i % 17 == 0 else float(r), f"k{k}") for i, (u, s, r, k) in enumerate(zip(unit, size, rooms, kind))]
    return spark.createDataFrame(rows, "listing_id long, fold int, price double, property_size_sqft double, bedroom double, kind string")


def test_tweedie_models_settle_where_mllib_does(spark):
    df = market(spark)
    encoded = crossfit.encode_folds(df, ("property_size_sqft", "bedroom"), ("kind",), F.col("price") / F.col("property_size_sqft"), "listing_id")
    found = crossfit.tweedie_models(encoded, {"low": 1.1, "high": 1.9})
    for name, power in (("low", 1.1), ("high", 1.9)):
        train = VectorAssembler(inputCols=encoded.features, outputCol="x").transform(encoded.train(2))
        wanted = GeneralizedLinearRegression(family="tweedie", linkPower=0.0, variancePower=power, featuresCol="x", labelCol="_y", maxIter=100, tol=1e-10).fit(train)
        got = found[name][1]
        assert np.allclose([got.intercept, *got.weights], [wanted.intercept, *wanted.coefficients], rtol=1e-5, atol=1e-8)


def test_tweedie_specs_need_no_fit_of_their_own(spark, monkeypatch):
    """No limit on iterations is set, and all powers come from shared passes."""
    monkeypatch.setattr(models, "fit_pipeline", lambda *_: 1 / 0)
    specs = [models.Spec(f"t{p}", "tweedie", ("property_size_sqft", "bedroom"), ("kind",), (("variancePower", p),)) for p in (1.3, 1.7)]
    rows = models.oof_predict(market(spark), specs).collect()
    assert len(rows) == 800 and all(abs(np.log(r.predicted / r.actual)) < 0.6 for r in rows)
