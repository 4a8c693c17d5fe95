"""The plans used for large or skewed data, forced on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.operators import dedup, encode, evaluate, folds, geo, joins, models, order, quality, skew


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(3000) < 0.35, 0, rng.integers(1, 900, 3000))
    frame = pd.DataFrame({"i": np.arange(3000), "k": keys, "v": np.round(rng.random(3000), 2)})
    df = spark.createDataFrame(frame).withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    return df, df.toPandas()


@pytest.mark.parametrize("limit", [0, 10**9])
def test_attach_keeps_every_row(skewed, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    df, frame = skewed
    dim = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    out = skew.attach(df, dim, ["k"], "n").toPandas()
    assert len(out) == len(frame)
    wanted = frame.groupby("k", dropna=False)["v"].agg(["size", "sum"])
    merged = out.merge(wanted, left_on="k", right_index=True, how="left")
    assert (merged["n"] == merged["size"]).all()
    assert np.allclose(merged["total"], merged["sum"])


def test_attach_splits_hot_keys(spark, skewed, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    df, _ = skewed
    dim = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = skew.attach(df, dim, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastHashJoin" in plan and len(exchanges) == 2
    assert all("_salt#" in line or "_dim_salt#" in line for line in exchanges)


def test_quantiles_do_not_change_with_the_size_of_a_group(spark, monkeypatch):
    """Both paths give the same doubles, to the last digit."""
    rng = np.random.default_rng(11)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(5, size=3000), rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-8, 9, 3000))]
    df = spark.createDataFrame(rows + [(9, 1.0), (9, 1.0), (8, -0.5)], "g int, v double")
    wanted = {f"q{i}": i / 37 for i in range(38)}
    small = sorted(map(tuple, order.quantiles(df, ["g"], "v", wanted).collect()))
    monkeypatch.setattr(order, "PERCENTILE_ROWS", 0)
    assert small == sorted(map(tuple, order.quantiles(df, ["g"], "v", wanted).collect()))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_bucketed_quantiles_match_pandas(skewed, monkeypatch, by):
    monkeypatch.setattr(order, "PERCENTILE_ROWS", 0)
    df, frame = skewed
    df, frame = df.withColumn("g", F.col("i") % 3), frame.assign(g=frame["i"] % 3)
    wanted = {"a": 0.05, "b": 0.5, "c": 0.975, "d": 1.0}
    out = order.quantiles(df, by, "v", wanted).toPandas().sort_values(by or "a").reset_index(drop=True)
    for name, q in wanted.items():
        right = frame.groupby("g")["v"].quantile(q).to_numpy() if by else [frame["v"].quantile(q)]
        assert np.allclose(out[name], right)


def test_hashed_rank_is_dense(spark):
    df = spark.range(5000).withColumn("d", F.md5(F.col("id").cast("string")))
    out = order.hashed_rank(df, "d", "r").toPandas().sort_values("d")
    assert out["r"].tolist() == list(range(5000))


@pytest.mark.parametrize("limit", [0, 10**9])
def test_components_match_union_find(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, j) for j in range(101, 160)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    out = dedup.component_labels(spark.createDataFrame(pairs, "u long, v long")).collect()
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r["node"] for r in out} == linked
    assert all(r["component"] == find(r["node"]) for r in out)


def haversine(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def test_geo_matches_brute_force_under_skew(spark, monkeypatch):
    monkeypatch.setattr(geo, "LEAF", 8)
    rng = np.random.default_rng(1)
    lat, lon = 1 + rng.random(240), 101 + 2 * rng.random(240)
    lat[:80], lon[:80] = 1.5, 101.5
    lat[80:160], lon[80:160] = 1.2 + rng.random(80) * 1e-3, 102.2 + rng.random(80) * 1e-3
    lat[235:], lon[235:] = [0.0, 0.0, 89.9, -89.9, 10.0], [179.999, -179.999, 10.0, 20.0, 0.0]
    df = spark.createDataFrame(pd.DataFrame({"listing_id": np.arange(240), "lat": lat, "lon": lon}))
    distance = haversine(lat[:, None], lon[:, None], lat[None], lon[None])
    for row in geo.nearest(df, df, 6, "listing_id", exclude_self=True).collect():
        i = row["listing_id"]
        right = sorted((round(distance[i, j], 6), j) for j in range(240) if j != i)[:6]
        assert np.allclose([n["distance_km"] for n in row["neighbours"]], [d for d, _ in right], atol=1e-6)
    counts = geo.radius_counts(df, df, "listing_id", radii=(1.0, 25.0), exclude_self=True).toPandas().set_index("listing_id").sort_index()
    for r in (1, 25):
        assert (counts[f"within_{r}km"].to_numpy() == (distance <= r).sum(1) - 1).all()


def test_vector_neighbours_match_brute_force(spark, monkeypatch):
    from terrace.operators import models

    monkeypatch.setattr(geo, "LEAF", 8)
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.integers(0, 6, (260, 4)).astype(float), columns=list("abcd"))
    frame.loc[:90, list("abcd")] = 3.0
    frame["i"], frame["y"] = np.arange(260), rng.random(260)
    df = spark.createDataFrame(frame)
    train, held = frame[frame.i % 4 != 0], frame[frame.i % 4 == 0]
    out = models.fit_knn_regression(df.where("i % 4 <> 0"), df.where("i % 4 = 0"), list("abcd"), "y", "i", 5).toPandas().set_index("i")["predicted"]
    x, q = ((t[list("abcd")] - train[list("abcd")].mean()) / train[list("abcd")].std(ddof=0) for t in (train, held))
    for row, point in zip(held.i, q.to_numpy()):
        distance = np.round(np.sqrt(((x.to_numpy() - point) ** 2).sum(1)), 6)
        nearest = np.lexsort((train.i.to_numpy(), distance))[:5]
        assert out[row] == pytest.approx(train.y.to_numpy()[nearest].mean())


def test_attach_spreads_keys_that_only_the_rows_have(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    rows = spark.range(40_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id") % 500).cast("long").alias("k")
    )
    dim = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"), F.lit(1).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = skew.attach(rows, dim, ["k"], "w")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * sum(sizes) / 8
        assert out.where("k >= 0 and twice <> 2 * k or k >= 0 and twice is null or k < 0 and twice is not null").count() == 0
        assert out.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_encoders_keep_user_columns(spark):
    rows = spark.createDataFrame([(i, f"c{i % 3}", float(i), 9, "mine", 0.5) for i in range(30)], "id int, city string, y double, n int, category string, encoded double")
    for out in (encode.target_encode_m(rows, rows, "city", "y", 2.0), encode.count_encode(rows, rows, "city"), encode.target_encode_with_log_count(rows, rows, "city", "y", 2.0)):
        assert set(rows.columns) <= set(out.columns)
        assert out.where("n = 9 and category = 'mine' and encoded = 0.5").count() == 30
    with pytest.raises(ValueError, match="names"):
        skew.attach(rows, rows.groupBy("city").agg(F.count(F.lit(1)).alias("n")), ["city"], "n")


def test_ordinal_codes_of_labels_that_begin_alike(spark):
    rows = spark.range(900).select(F.format_string("Brand#%03d", F.col("id") % 300).alias("b"))
    codes = {r.b: r.b_code for r in encode.ordinal_encode(rows.where("b <> 'Brand#007'"), rows, "b").distinct().collect()}
    known = sorted(set(codes) - {"Brand#007"})
    assert codes["Brand#007"] == -1 and [codes[b] for b in known] == list(range(299))


def test_link_text_refuses_repeated_sources(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, text string")
    linked, audit = joins.link_text(rows, source, "k", "text")
    assert audit.first().source_ids_unique == 0
    with pytest.raises(Exception, match="repeats k 2"):
        linked.collect()
    assert joins.link_text(rows, source.where("text <> 'c'"), "k", "text")[0].count() == 2


def test_rows_with_missing_features_are_scored(spark):
    frame = spark.range(200).select(
        F.col("id").alias("listing_id"), (F.col("id") % 5 + 1).cast("int").alias("fold"), (F.col("id") * 10.0 + 100).alias("price"),
        F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("id") * 1.0).alias("size"), F.when(F.col("id") % 7 != 0, F.col("id") * 2.0).alias("rooms"),
    ).withColumn("premium", (F.col("price") > 1500).cast("int"))
    spec = models.Spec("ridge", "ridge", ("size", "rooms"), (), (("regParam", 0.01),), "direct", size="size")
    assert quality.oof_coverage(models.oof_predict(frame, [spec]), "listing_id", frame).first().unscored == 0
    classifier = models.fit_premium_classifier(frame, ["size", "rooms"], "premium", maxIter=2)
    scored = models.premium_probability(frame, classifier)
    assert scored.count() == 200 and scored.where("probability is null").count() == 0 and "size" in scored.columns


def test_tail_edges_count_every_id_once(spark):
    """The first model lacks most rows and repeats one."""
    rows = [("a", 0, 0.0)] * 3 + [("b", i, float(i)) for i in range(101)]
    edges = evaluate.tail_segments(spark.createDataFrame(rows, "model string, listing_id long, actual double")).select("p95_threshold", "p99_threshold").distinct().collect()
    assert [tuple(r) for r in edges] == [(95.0, 99.0)]


@pytest.mark.parametrize("shape", ["many", "hot", "few"])
def test_group_folds_balance_whatever_the_number_of_groups(spark, shape):
    rng = np.random.default_rng(4)
    sizes = {"many": rng.integers(1, 9, 3000), "hot": np.array([900, *rng.integers(1, 4, 700)]), "few": np.array([5, 3, 3])}[shape]
    rows = [(None if g == 1 else f"g{g}", i) for g, n in enumerate(sizes) for i in range(int(n))]
    df = spark.createDataFrame(rows, "g string, i int")
    got = folds.assign_group_kfold_balanced(df, "g", 5).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        assert of.setdefault(r.g, r.fold) == r.fold and 1 <= r.fold <= 5
    loads = np.bincount([r.fold for r in got], minlength=6)[1:]
    assert loads.max() - loads.min() <= sizes.max()
    again = {r.g: r.fold for r in folds.assign_group_kfold_balanced(df.repartition(7), "g", 5).collect()}
    assert again == of


def test_group_folds_of_an_empty_table(spark):
    assert folds.assign_group_kfold_balanced(spark.createDataFrame([], "g string"), "g").count() == 0


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_fold_quantiles_count_values_before_copying(spark, monkeypatch, rows):
    """Each fold's training quantiles are those of the training rows themselves, on either path."""
    df = spark.range(4000).selectExpr("id % 2 AS g", "CAST(id % 5 + 1 AS INT) AS fold", "CASE WHEN id % 11 <> 0 THEN CAST(id * 7919 % 1013 AS DOUBLE) / 7 END AS v")
    wanted = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 1.0}
    plain = {(g, k): df.where(f"g = {g} AND fold <> {k}").selectExpr(*[f"percentile(v, {q}D) AS {n}" for n, q in wanted.items()]).first() for g in (0, 1) for k in range(1, 6)}
    monkeypatch.setattr(order, "PERCENTILE_ROWS", rows)
    found = order.fold_quantiles(df, ["g"], "v", wanted, "fold", 5).collect()
    assert {(r.g, r.outer_fold): tuple(r[n] for n in wanted) for r in found} == {key: tuple(r) for key, r in plain.items()}


def test_large_groups_rank_only_the_rows_near_a_quantile(spark, monkeypatch):
    """Rows that cannot be a quantile are counted and never shuffled or sorted."""
    monkeypatch.setattr(order, "PERCENTILE_ROWS", 0)
    monkeypatch.setattr(order, "bucketed_quantiles", lambda *a: pytest.fail("all rows were ranked"))
    df = spark.range(200_000).selectExpr("id % 3 AS g", "CAST(id * 7919 % 200003 AS DOUBLE) AS v")
    found = {r.g: (r.a, r.b) for r in order.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.99}).collect()}
    exact = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(*[F.expr(f"percentile(v, {q}D)").alias(n) for n, q in (("a", 0.5), ("b", 0.99))]).collect()}
    assert found == exact


def test_fold_encodings_are_not_interpreted_row_by_row(spark):
    """The pick of each fold's encoding is compiled: no lambda runs over the joined rows."""
    from pyspark.sql import functions as F

    from terrace.operators.crossfit import with_fold_encodings

    df = spark.range(100).selectExpr("CAST(id % 3 AS STRING) AS c", "CAST(id % 5 + 1 AS INT) AS fold", "CAST(id % 4 + 1 AS INT) AS _inner", "CAST(id AS DOUBLE) AS _y")
    overall = df.groupBy(F.col("fold").alias("f"), F.col("_inner").alias("i")).agg(F.count("_y").alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v")).collect()
    made = with_fold_encodings(df, "c", "fold", 5, overall)
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_medians_of_many_rows_count_values_once(spark, monkeypatch):
    """One pass for all columns of a large table, with the medians of a small one."""
    df = spark.range(3000).selectExpr("CAST(id * 7 % 101 AS DOUBLE) AS a", "CASE WHEN id % 3 <> 0 THEN id % 17 END AS b", "CAST(NULL AS DOUBLE) AS c")
    small = models._medians(df, ["a", "b", "c"])
    monkeypatch.setattr(models, "PERCENTILE_ROWS", 0)
    monkeypatch.setattr(models, "quantiles", lambda *a: pytest.fail("one job a column"))
    assert models._medians(df, ["a", "b", "c"]) == small


def test_cohorts_are_told_without_a_sort(spark):
    rows = [(1, "a", 1.0), (2, None, 1.0), (3, "b", None), (None, "c", 2.0)]
    df = spark.createDataFrame(rows, "i long, developer string, floors double")
    from terrace.operators import filters

    told = filters.cohort_summary(df, ["developer", "floors"], ["developer", "floors"], ["developer"], "i")
    labels = filters.cohort_labels(df, ["developer", "floors"], ["developer", "floors"], ["developer"])
    expected = labels.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"), F.min("i").alias("first_id"), F.max("i").alias("last_id"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, expected.collect()))
    assert told.where("cohort = 'C_complete_core'").first().asDict() == {"cohort": "C_complete_core", "rows": 2, "first_id": 1, "last_id": 1}
    text = filters.cohort_summary(df.withColumn("i", F.col("i").cast("string")), ["developer", "floors"], ["developer", "floors"], ["developer"], "i")
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "Sort [" not in plan
    none = filters.cohort_summary(df.where("developer IS NULL"), ["developer"], ["developer"], ["developer"], "i")
    assert sorted(r.cohort for r in none.collect()) == ["A_current", "H_missing_indicators"]


def test_wide_predictions_shuffle_each_id_once(spark):
    from terrace.operators import stats

    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (1, "b", 4.0), (2, "b", 3.0), (2, "b", 2.0), (3, "c", 1.0)], "i long, model string, predicted double")
    wide = stats.wide_predictions(rows, "i", ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, 4.0), (2, None, 3.0), (3, None, None)]
    assert wide._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_training_quantiles_without_copies(spark, monkeypatch, limit):
    from terrace.operators import folds, order

    monkeypatch.setattr(order, "PERCENTILE_ROWS", limit)
    rows = [(i, i % 5 + 1, float((i * 37) % 101)) for i in range(400)] + [(401, 1, None), (402, 2, float("nan")), (403, None, 5.0)]
    df = spark.createDataFrame(rows, "i long, fold int, v double")
    wanted = {f"q{i}": q for i, q in enumerate((0.0, 0.005, 0.05, 0.333, 0.5, 0.9, 0.99, 1.0))}
    found = {r.outer_fold: r for r in order.training_quantiles(df, "v", wanted).collect()}
    for k in range(1, 6):
        values = [v for _, f, v in rows if f is not None and f != k and v is not None and v == v]
        assert [found[k][n] for n in wanted] == [pytest.approx(float(np.quantile(values, q))) for q in wanted.values()]
    bounds = folds.winsor_bounds(df, "v", (("s", 0.05, 0.95), ("u", None, 0.9)))
    for r in bounds.collect():
        train = [v for _, f, v in rows if f is not None and f != r.fold]
        assert r.training_rows == len(train)
        low = 0 if r.lower_bound is None else sum(v is not None and v < r.lower_bound for v in train)
        assert (r.lower_clipped, r.upper_clipped) == (low, sum(v is not None and (v != v or v > r.upper_bound) for v in train))
    plan = order.training_quantiles(df, "v", wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1, 5" not in plan
