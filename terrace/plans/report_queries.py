"""Joins, exploratory aggregates, ranks and folds over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import parse
from terrace.operators import evaluate, filters, folds, joins, stats, windows
from terrace.plans.cleaning_queries import BAND_SQL, BANDS, CORE, EDGES, MISS
from terrace.plans.registry import query, rounded, sql_fold, sql_hash, with_listings, with_scored
from terrace.sources.surrogate import MODELS, listings, scored, table

# --- joins -----------------------------------------------------------------


@query("join_left_one_to_one", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(spark, sf):
    right = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    # Orders repeat customers, so only the right side is checked for uniqueness.
    from terrace.operators.quality import expect_unique

    expect_unique(right, ["o_custkey"])
    return joins.left_one_to_one(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), right, ["o_custkey"], check=False)


@query("join_left_default", "SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, sf):
    counts = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return joins.left_with_default(table(spark, sf, "customer").select("c_custkey"), counts, ["c_custkey"], {"orders": 0})


@query("join_inner_one_to_one", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    return joins.inner_one_to_one(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), ["doc_id"])


@query("join_lookup_fallback", with_listings(
    ", d AS (SELECT developer, avg(unit_price) AS v FROM listings WHERE developer IS NOT NULL AND price > 60000 GROUP BY 1) SELECT listing_id, round(coalesce(v, -1.0), 4) AS developer_mean FROM listings LEFT JOIN d USING (developer)"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "developer", "unit_price", "price"])
    dim = df.where("developer IS NOT NULL AND price > 60000").groupBy("developer").agg(F.avg("unit_price").alias("developer_mean"), F.count(F.lit(1)).alias("n"))
    found = joins.lookup(df.select("listing_id", "developer"), dim, ["developer"], "n", {"developer_mean": -1.0})
    return rounded(found.select("listing_id", "developer_mean"))


@query("join_hierarchical_fallback", with_listings(
    ", t AS (SELECT * FROM listings WHERE price > 80000), a AS (SELECT building_name AS k, avg(unit_price) AS v FROM t WHERE property_type = 'SMALL' GROUP BY 1), b AS (SELECT city AS k, avg(unit_price) AS v FROM t WHERE state <> 'ASIA' GROUP BY 1)"
    " SELECT listing_id, round(coalesce(a.v, b.v, (SELECT avg(unit_price) FROM t)), 4) AS reference_price FROM listings l LEFT JOIN a ON l.building_name = a.k AND l.property_type = 'SMALL' LEFT JOIN b ON l.city = b.k"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "building_name", "city", "state", "property_type", "unit_price", "price"])
    train = df.where("price > 80000")

    def level(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.avg("unit_price").alias("v"), F.count(F.lit(1)).alias("n"))

    fine = level(train.where("property_type = 'SMALL'"), "building_name").withColumnRenamed("building_name", "small_building")
    rows = df.withColumn("small_building", F.when(F.col("property_type") == "SMALL", F.col("building_name")))
    chain = [("small_building", fine), ("city", level(train.where("state <> 'ASIA'"), "city"))]
    found = joins.hierarchical_lookup(rows, chain, "v", "n", train.agg(F.avg("unit_price").alias("v")), "reference_price")
    return rounded(found.select("listing_id", "reference_price"))


@query("join_semi_by_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return joins.semi_by_ids(table(spark, sf, "documents").select("doc_id", "lang"), ids, ["doc_id"])


@query("join_id_set_difference", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def _(spark, sf):
    return joins.id_set_difference(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("join_align_predictions", with_listings(", p AS (SELECT listing_id, price * 1.01 AS predicted FROM listings WHERE bedroom > 1) SELECT listing_id, price, round(predicted, 4) AS predicted FROM listings JOIN p USING (listing_id)"))
def _(spark, sf):
    df = listings(spark, sf, ["listing_id", "price", "bedroom"])
    external = df.where("bedroom > 1").select("listing_id", (F.col("price") * 1.01).alias("predicted"))
    return rounded(joins.align_predictions(df.select("listing_id", "price"), external, "listing_id"))


@query("join_link_text_audit",
       "WITH s AS (SELECT doc_id, count(*) AS copies FROM documents WHERE lang <> 'de' GROUP BY 1), m AS (SELECT doc_id, count(*) AS n, max(copies) AS copies FROM labels l LEFT JOIN s USING (doc_id) GROUP BY doc_id)"
       " SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(CASE WHEN copies IS NOT NULL THEN n END), 0) AS BIGINT) AS linked, CAST(coalesce(sum(CASE WHEN copies IS NULL THEN n END), 0) AS BIGINT) AS missing,"
       " CAST(max(n) = 1 AS INTEGER) AS row_ids_unique, CAST(coalesce(max(copies), 1) = 1 AS INTEGER) AS source_ids_unique, count(*) FILTER (WHERE n > 1 AND copies > 1) AS many_to_many FROM m")
def _(spark, sf):
    source = table(spark, sf, "documents").where("lang <> 'de'").select("doc_id", "text")
    return joins.link_text(table(spark, sf, "labels"), source, "doc_id", "text")[1]


@query("join_link_text", "SELECT doc_id, quality, length(text) AS chars FROM labels JOIN documents USING (doc_id)")
def _(spark, sf):
    linked, _ = joins.link_text(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return linked.select("doc_id", "quality", F.length("text").alias("chars"))


@query("join_cross_scopes", with_scored("SELECT model, scope, fold, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae FROM scored CROSS JOIN (VALUES (50000.0), (80000.0), (1e9)) s(scope) WHERE actual <= scope GROUP BY ALL"))
def _(spark, sf):
    crossed = joins.cross_small(scored(spark, sf), ("scope", [50000.0, 80000.0, 1e9]))
    grouped = crossed.where("actual <= scope").groupBy("model", "scope", "fold")
    return rounded(grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae")))


# --- aggregates ------------------------------------------------------------


@query("agg_mean_count", with_listings("SELECT state, round(avg(price), 4) AS mean, count(price) AS count FROM listings GROUP BY 1 HAVING count(price) >= 10"))
def _(spark, sf):
    return rounded(stats.group_mean_count(listings(spark, sf, ["state", "price"]), "state", "price", 10))


@query("agg_mean_median_long", with_listings(
    ", w AS (SELECT state, count(price) AS count, avg(price) AS mean, quantile_cont(price, 0.5) AS median FROM listings GROUP BY 1) SELECT state, count, 'mean' AS statistic, round(mean, 4) AS value FROM w UNION ALL SELECT state, count, 'median', round(median, 4) FROM w"))
def _(spark, sf):
    return rounded(stats.group_mean_median_count(listings(spark, sf, ["state", "price"]), "state", "price"))


@query("agg_median_two_keys", with_listings("SELECT state, tenure_type, count(price) AS count, round(quantile_cont(price, 0.5), 4) AS median FROM listings GROUP BY ALL HAVING count(price) >= 20"))
def _(spark, sf):
    return rounded(stats.group_median_count(listings(spark, sf, ["state", "tenure_type", "price"]), ["state", "tenure_type"], "price", 20))


@query("agg_median_every_band", with_listings(
    f", d AS (SELECT * FROM (VALUES (0, 'xs'), (1, 's'), (2, 'm'), (3, 'l'), (4, 'xl'), (5, 'xxl'), (6, 'giant')) v(band_order, size_band)), g AS (SELECT {BAND_SQL.format(c='property_size_sqft')} AS size_band, count(price) AS n, quantile_cont(price, 0.5) AS m FROM listings GROUP BY 1)"
    " SELECT band_order, size_band, coalesce(n, 0) AS count, round(m, 4) AS median FROM d LEFT JOIN g USING (size_band)"))
def _(spark, sf):
    df = listings(spark, sf, ["property_size_sqft", "price"]).withColumn("size_band", parse.band(F.col("property_size_sqft"), EDGES, BANDS))
    return rounded(stats.group_median_complete(df, "size_band", [*BANDS, "giant"], "price"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "VILLA"]


def _pivot_sql(row: str, column: str, values: list, value: str, where: str = "") -> str:
    cells = ", ".join(f"round(quantile_cont({value}, 0.5) FILTER (WHERE {column} = {v!r}), 4) AS \"{v}\"" for v in values)
    return with_listings(f"SELECT {row}, {cells} FROM listings {where} GROUP BY 1")


@query("eda_state_type_median", _pivot_sql("state", "property_type", TYPES, "unit_price", "WHERE unit_price BETWEEN 50 AND 5000"))
def _(spark, sf):
    df = filters.keep_between(listings(spark, sf, ["state", "property_type", "unit_price"]), F.col("unit_price"), 50, 5000)
    return rounded(stats.pivot_median(df, "state", "property_type", TYPES, "unit_price"))


@query("eda_bedroom_size_median", with_listings(
    f", b AS (SELECT bedroom, price, {BAND_SQL.format(c='property_size_sqft')} AS size_band FROM listings) SELECT bedroom, " + ", ".join(f"round(quantile_cont(price, 0.5) FILTER (WHERE size_band = '{v}'), 4) AS {v}" for v in BANDS) + " FROM b GROUP BY 1"))
def _(spark, sf):
    df = listings(spark, sf, ["bedroom", "price", "property_size_sqft"]).withColumn("size_band", parse.band(F.col("property_size_sqft"), EDGES, BANDS))
    return rounded(stats.pivot_median(df, "bedroom", "size_band", list(BANDS), "price"))


@query("eda_state_period_median", with_listings(
    ", b AS (SELECT state, price, CASE WHEN completion_year < 1997 THEN 'early' WHEN completion_year < 2000 THEN 'middle' ELSE 'late' END AS period FROM listings WHERE completion_year IS NOT NULL),"
    " k AS (SELECT state FROM b GROUP BY 1 HAVING count(*) >= 100) SELECT state, " + ", ".join(f"round(quantile_cont(price, 0.5) FILTER (WHERE period = '{v}'), 4) AS {v}" for v in ("early", "middle", "late")) + " FROM b JOIN k USING (state) GROUP BY 1"))
def _(spark, sf):
    df = filters.drop_null(listings(spark, sf, ["state", "price", "completion_year"]), ["completion_year"])
    df = df.withColumn("period", parse.band(F.col("completion_year"), [1997, 2000], ["early", "middle", "late"], right_closed=False))
    return rounded(stats.pivot_median(filters.filter_groups_min_count(df, ["state"], 100), "state", "period", ["early", "middle", "late"], "price"))


NUMERIC = ["price", "property_size_sqft", "bedroom", "completion_year", "number_of_floors", "total_units"]


@query("eda_describe", with_listings(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,"
    f" round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75 FROM listings" for c in NUMERIC)))
def _(spark, sf):
    return rounded(stats.describe(listings(spark, sf, NUMERIC), NUMERIC))


@query("eda_distribution", with_listings(
    "SELECT property_type, count(price) AS count, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, min(price) AS min, max(price) AS max, round(skewness(price), 4) AS skew,"
    " round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95 FROM listings GROUP BY 1"))
def _(spark, sf):
    return rounded(stats.distribution(listings(spark, sf, ["property_type", "price"]), "price", ["property_type"]))


@query("eda_price_distribution", with_listings(
    "SELECT count(price) AS rows, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, max(price) AS max, round(skewness(price), 4) AS skew, round(quantile_cont(price, 0.5), 4) AS median,"
    " round(quantile_cont(price, 0.9), 4) AS p90, round(quantile_cont(price, 0.95), 4) AS p95, round(quantile_cont(price, 0.99), 4) AS p99 FROM listings"))
def _(spark, sf):
    return rounded(stats.price_distribution(listings(spark, sf, ["price"]), "price"))


@query("agg_quantiles", with_listings("SELECT city, round(quantile_cont(unit_price, 0.1), 4) AS p10, round(quantile_cont(unit_price, 0.9), 4) AS p90 FROM listings GROUP BY 1"))
def _(spark, sf):
    from terrace.operators.order import quantiles

    return rounded(quantiles(listings(spark, sf, ["city", "unit_price"]), ["city"], "unit_price", {"p10": 0.1, "p90": 0.9}))


@query("agg_quantile_bands", with_listings(
    ", q AS (SELECT quantile_cont(price, 0.0) AS a, quantile_cont(price, 0.95) AS b, quantile_cont(price, 0.99) AS c, quantile_cont(price, 1.0) AS d FROM listings) SELECT listing_id,"
    " CASE WHEN price >= a AND price < b THEN 'P00_P95' WHEN price >= b AND price < c THEN 'P95_P99' WHEN price >= c AND price <= d THEN 'P99_P100' END AS band,"
    " round(CASE WHEN price < b THEN a WHEN price < c THEN b ELSE c END, 4) AS lower_bound, round(CASE WHEN price < b THEN b WHEN price < c THEN c ELSE d END, 4) AS upper_bound FROM listings, q"))
def _(spark, sf):
    return rounded(stats.quantile_bands(listings(spark, sf, ["listing_id", "price"]), "price").drop("price"))


PROFILE = ["price", "city", "completion_year", "number_of_floors", "developer", "bedroom"]


@query("agg_dataset_profile", with_listings(
    f", p AS (SELECT listing_id, {', '.join(PROFILE)} FROM listings), g AS (SELECT count(*) AS n FROM p GROUP BY {', '.join(PROFILE)}) SELECT (SELECT count(*) FROM p) AS rows, 7 AS columns,"
    " (SELECT CAST(sum((city IS NULL)::INT + (completion_year IS NULL)::INT + (number_of_floors IS NULL)::INT + (developer IS NULL)::INT) AS BIGINT) FROM p) AS missing_total,"
    " (SELECT count(DISTINCT city) FROM p) AS city_unique_count, CAST(0 AS BIGINT) AS duplicate_rows, (SELECT CAST(sum(n - 1) AS BIGINT) FROM g) AS duplicate_rows_excluding_id"))
def _(spark, sf):
    return stats.dataset_profile(listings(spark, sf, ["listing_id", *PROFILE]), "city", "listing_id")


@query("agg_missing_by_column", with_listings(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM listings" for c in CORE)))
def _(spark, sf):
    return stats.missing_by_column(listings(spark, sf, ["city", *CORE]))


@query("agg_stage_overview", with_listings(
    ", s0 AS (SELECT price, city, completion_year FROM listings), s1 AS (SELECT * FROM s0 WHERE completion_year IS NOT NULL), d0 AS (SELECT count(*) AS n FROM s0 GROUP BY price, city, completion_year), d1 AS (SELECT count(*) AS n FROM s1 GROUP BY price, city, completion_year)"
    " SELECT 0 AS stage_order, 'raw' AS stage, (SELECT count(*) FROM s0) AS rows, 3 AS columns, (SELECT count(*) - count(completion_year) FROM s0) AS missing_cells, (SELECT CAST(sum(n - 1) AS BIGINT) FROM d0) AS duplicate_rows"
    " UNION ALL SELECT 1, 'prepared', (SELECT count(*) FROM s1), 3, 0, (SELECT CAST(sum(n - 1) AS BIGINT) FROM d1)"))
def _(spark, sf):
    df = listings(spark, sf, ["price", "city", "completion_year"])
    return stats.stage_overview({"raw": df, "prepared": filters.drop_null(df, ["completion_year"])})


@query("agg_missing_pct", with_listings(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct FROM listings" for c in CORE)))
def _(spark, sf):
    return rounded(stats.missing_pct(listings(spark, sf, ["city", *CORE]), ["city", *CORE]))


SUMMED = ["price", "bathroom", "completion_year", "developer"]


@query("agg_missingness_summary", with_listings(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS feature_order, {int(c in CORE)} AS important_feature, count(*) - count({c}) AS missing_count, count({c}) AS non_missing_count,"
    f" {'NULL' if c == 'developer' else f'count(*) FILTER (WHERE {c} = 0)'} AS zero_count, round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct FROM listings" for i, c in enumerate(SUMMED))))
def _(spark, sf):
    return rounded(stats.missingness_summary(listings(spark, sf, SUMMED), SUMMED, CORE))


@query("agg_missingness_by_group", with_listings(" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, coalesce({d}, '<NA>') AS value, count(*) AS rows, round(avg({MISS}), 4) AS mean_missing, round(avg(({MISS} = 0)::INT) * 100, 4) AS complete_rows_pct, '{c}' AS feature, round(avg(({c} IS NULL)::INT) * 100, 4) AS missing_pct FROM listings GROUP BY {d}"
    for d in ("state", "property_type") for c in CORE)))
def _(spark, sf):
    df = listings(spark, sf, ["state", "property_type", *CORE])
    return rounded(stats.missingness_by_group(df, ["state", "property_type"], CORE))


@query("agg_category_share", with_listings("SELECT coalesce(developer, '<NA>') AS category, round(count(*) / CAST((SELECT count(*) FROM listings) AS DOUBLE), 6) AS share FROM listings GROUP BY 1"))
def _(spark, sf):
    return rounded(stats.category_share(listings(spark, sf, ["developer"]), "developer"), 6)


def _tv(column: str) -> str:
    return (f"(SELECT sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 FROM (SELECT coalesce({column}, '<NA>') AS k, count(*) / CAST((SELECT count(*) FROM kept) AS DOUBLE) AS p FROM kept GROUP BY 1) a"
            f" FULL JOIN (SELECT coalesce({column}, '<NA>') AS k, count(*) / CAST((SELECT count(*) FROM listings) AS DOUBLE) AS p FROM listings GROUP BY 1) b ON a.k = b.k)")


@query("agg_total_variation", with_listings(f", kept AS (SELECT * FROM listings WHERE price <= 40000) SELECT round({_tv('developer')}, 6) AS total_variation"))
def _(spark, sf):
    df = listings(spark, sf, ["developer", "price"])
    return rounded(stats.total_variation(df.where("price <= 40000"), df, "developer"), 6)


_SHAPE = "count(price) AS {p}rows, avg(price) AS {p}mean, quantile_cont(price, 0.5) AS {p}median, stddev_samp(price) AS {p}std, quantile_cont(price, 0.95) AS {p}p95, quantile_cont(price, 0.99) AS {p}p99, max(price) AS {p}max, skewness(price) AS {p}skew"
_STATS = ("mean", "median", "std", "p95", "p99", "max", "skew")


@query("agg_distribution_shift", with_listings(
    f", kept AS (SELECT * FROM listings WHERE price <= 85000), a AS (SELECT {_SHAPE.format(p='a_')} FROM kept), b AS (SELECT {_SHAPE.format(p='b_')} FROM listings),"
    " t AS (SELECT count(*) FILTER (WHERE l.price >= b_p95) AS b5, count(*) FILTER (WHERE l.price >= b_p99) AS b1, count(*) FILTER (WHERE l.price >= b_p95 AND l.price <= 85000) AS k5, count(*) FILTER (WHERE l.price >= b_p99 AND l.price <= 85000) AS k1 FROM listings l, b),"
    f" v AS (SELECT {_tv('property_type')} AS tv_type, {_tv('state')} AS tv_state),"
    " o AS (SELECT a_rows AS rows, b_rows AS base_rows, " + ", ".join(f"a_{s} AS after_{s}, b_{s} AS before_{s}, (a_{s} - b_{s}) / b_{s} * 100 AS {s}_change_pct" for s in _STATS)
    + ", a_rows * 100.0 / b_rows AS retention_pct, k5 * 100.0 / greatest(b5, 1) AS top5_retention_pct, k1 * 100.0 / greatest(b1, 1) AS top1_retention_pct, tv_type AS property_type_total_variation, tv_state AS state_total_variation FROM a, b, t, v),"
    " r AS (SELECT *, list_filter([CASE WHEN retention_pct < 90 THEN 'row retention below 90%' END, " + ", ".join(f"CASE WHEN abs({s}_change_pct) >= 10 THEN '{s} changed by at least 10%' END" for s in _STATS if s != "skew")
    + ", CASE WHEN top5_retention_pct < 90 THEN 'top-5% retention below 90%' END, CASE WHEN top1_retention_pct < 90 THEN 'top-1% retention below 90%' END, CASE WHEN property_type_total_variation >= 0.1 THEN 'property_type total variation at least 0.10' END, CASE WHEN state_total_variation >= 0.1 THEN 'state total variation at least 0.10' END], lambda x: x IS NOT NULL) AS reasons FROM o)"
    " SELECT rows, base_rows, " + ", ".join(f"round({c}, 4) AS {c}" for s in _STATS for c in (f"after_{s}", f"before_{s}", f"{s}_change_pct"))
    + ", " + ", ".join(f"round({c}, 4) AS {c}" for c in ("retention_pct", "top5_retention_pct", "top1_retention_pct", "property_type_total_variation", "state_total_variation"))
    + ", array_to_string(reasons, ';') AS shift_reasons, CAST(len(reasons) > 0 AS INTEGER) AS substantial_shift FROM r"))
def _(spark, sf):
    df = listings(spark, sf, ["price", "property_type", "state"])
    return rounded(stats.distribution_shift(df.where("price <= 85000"), df, "price", ["property_type", "state"]))


FLAG_WORDS = {"has_light": "light", "has_number": "[0-9]", "has_the": " the ", "has_zebra": "zebra", "has_la": " la "}


@query("agg_frequency_table", ("WITH f AS (SELECT " + ", ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER) AS {n}" for n, p in FLAG_WORDS.items()) + " FROM documents), l AS ("
       + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST(sum({n}) AS BIGINT) AS count, count(*) AS rows FROM f" for n in FLAG_WORDS)
       + ") SELECT feature, count, round(count * 100.0 / rows, 4) AS percentage, CASE WHEN count < 3 THEN 'extremely rare' WHEN count < 10 THEN 'rare' WHEN count < 100 THEN 'moderate' ELSE 'common' END AS frequency_class, CAST(count >= 10 AS INTEGER) AS modeled FROM l"))
def _(spark, sf):
    df = table(spark, sf, "documents").select(*[parse.regex_flag(F.col("text"), p).alias(n) for n, p in FLAG_WORDS.items()])
    return rounded(stats.frequency_table(df, list(FLAG_WORDS)))


@query("agg_pearson", with_listings("SELECT round(corr(property_size_sqft, price), 6) AS pearson FROM listings"))
def _(spark, sf):
    return rounded(stats.pearson(listings(spark, sf, ["property_size_sqft", "price"]), "property_size_sqft", "price"), 6)


@query("agg_residual_correlation", with_scored(
    ", e AS (SELECT model, listing_id, predicted - actual AS e FROM scored) SELECT a.model AS model_x, b.model AS model_y, round(CASE WHEN a.model = b.model THEN 1.0 ELSE corr(a.e, b.e) END, 6) AS correlation FROM e a JOIN e b USING (listing_id) GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(stats.residual_correlation_matrix(scored(spark, sf), "listing_id", list(MODELS)), 6)


@query("agg_observed_ranges", with_listings(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum FROM listings" for c in NUMERIC)))
def _(spark, sf):
    return stats.observed_ranges(listings(spark, sf, NUMERIC), NUMERIC)


@query("agg_distinct_values", with_listings("SELECT DISTINCT trim(developer) AS value FROM listings WHERE trim(developer) <> ''"))
def _(spark, sf):
    return stats.distinct_values(listings(spark, sf, ["developer"]), "developer")


@query("agg_physical_profile", with_listings(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum, count(*) FILTER (WHERE CAST({c} AS DOUBLE) % 1 <> 0) AS non_integer FROM listings" for c in NUMERIC)))
def _(spark, sf):
    return stats.physical_profile(listings(spark, sf, NUMERIC), NUMERIC)


@query("agg_histogram", with_listings(
    ", r AS (SELECT property_type, min(price) AS lo, max(price) AS hi FROM listings GROUP BY 1) SELECT property_type, CAST(least(floor((price - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS count FROM listings JOIN r USING (property_type) GROUP BY 1, 2"))
def _(spark, sf):
    return stats.histogram(listings(spark, sf, ["property_type", "price"]), "price", 50, "property_type")


@query("agg_hexbin", with_listings(
    ", b AS (SELECT min(property_size_sqft) AS x0, max(property_size_sqft) AS x1, min(price) AS y0, max(price) AS y1 FROM listings),"
    " g AS (SELECT (property_size_sqft - x0) / (x1 - x0) * 30 AS gx, (price - y0) / (y1 - y0) * 17 AS gy FROM listings, b),"
    " d AS (SELECT gx, gy, (gx - floor(gx + 0.5)) * (gx - floor(gx + 0.5)) + 3.0 * (gy - floor(gy + 0.5)) * (gy - floor(gy + 0.5)) AS d1, (gx - floor(gx) - 0.5) * (gx - floor(gx) - 0.5) + 3.0 * (gy - floor(gy) - 0.5) * (gy - floor(gy) - 0.5) AS d2 FROM g)"
    " SELECT CASE WHEN d1 < d2 THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN d1 < d2 THEN floor(gx + 0.5) ELSE floor(gx) END AS BIGINT) AS hex_x, CAST(CASE WHEN d1 < d2 THEN floor(gy + 0.5) ELSE floor(gy) END AS BIGINT) AS hex_y, count(*) AS count FROM d GROUP BY 1, 2, 3"))
def _(spark, sf):
    return stats.hexbin_counts(listings(spark, sf, ["property_size_sqft", "price"]), "property_size_sqft", "price", 30)


@query("agg_ecdf", with_listings(", d AS (SELECT tenure_type, price, count(*) AS n FROM listings GROUP BY 1, 2) SELECT tenure_type, price, round(CAST(sum(n) OVER (PARTITION BY tenure_type ORDER BY price) AS DOUBLE) / sum(n) OVER (PARTITION BY tenure_type), 8) AS cumulative_share FROM d"))
def _(spark, sf):
    return rounded(stats.ecdf(listings(spark, sf, ["tenure_type", "price"]), "price", "tenure_type"), 8)


@query("agg_box_summary", with_listings(
    ", q AS (SELECT floor_range, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) AS q3 FROM listings GROUP BY 1) SELECT floor_range, round(max(q1), 4) AS q1, round(max(m), 4) AS median, round(max(q3), 4) AS q3,"
    " min(price) FILTER (WHERE price >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(price) FILTER (WHERE price <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS outliers FROM listings JOIN q USING (floor_range) GROUP BY 1"))
def _(spark, sf):
    return rounded(stats.box_summary(listings(spark, sf, ["floor_range", "price"]), "floor_range", "price"))


@query("agg_letter_values", with_listings(" UNION ALL ".join(
    f"SELECT land_title, '{side}_{d}' AS letter, round(quantile_cont(price, {q}), 4) AS value FROM listings GROUP BY 1" for d in (1, 2, 3, 4) for side, q in (("lower", 0.5**d), ("upper", 1 - 0.5**d)))))
def _(spark, sf):
    return rounded(stats.letter_values(listings(spark, sf, ["land_title", "price"]), "land_title", "price"))


@query("agg_kde", with_listings(
    ", s AS (SELECT parking_lot, count(unit_price) AS n, stddev_samp(unit_price) * pow(count(unit_price), -0.2) AS h FROM listings GROUP BY 1), e AS (SELECT min(unit_price) AS a, max(unit_price) AS b FROM listings), g AS (SELECT unnest(range(0, 20)) AS grid_index),"
    " p AS (SELECT CAST(grid_index AS INTEGER) AS grid_index, a + (b - a) * grid_index / 19 AS grid_value FROM g, e) SELECT parking_lot, grid_index, round(max(grid_value), 4) AS grid_value,"
    " round(sum(exp(-0.5 * ((grid_value - unit_price) / h) * ((grid_value - unit_price) / h))) / (max(n) * max(h) * sqrt(2 * pi())), 8) AS density FROM listings JOIN s USING (parking_lot) CROSS JOIN p GROUP BY 1, 2"))
def _(spark, sf):
    out = stats.kde(listings(spark, sf, ["parking_lot", "unit_price"]), "unit_price", "parking_lot", 20)
    return out.withColumns({"grid_value": F.round("grid_value", 4), "density": F.round("density", 8)})


@query("agg_row_missing_distribution", with_listings(f"SELECT {MISS} AS missing_fields, count(*) AS rows FROM listings GROUP BY 1"))
def _(spark, sf):
    return stats.row_missing_distribution(listings(spark, sf, CORE), CORE)


@query("agg_predictions_wide", with_scored("SELECT listing_id, " + ", ".join(f"round(max(predicted) FILTER (WHERE model = '{m}'), 4) AS prediction__{m}" for m in MODELS) + " FROM scored GROUP BY 1"))
def _(spark, sf):
    return rounded(stats.wide_predictions(scored(spark, sf), "listing_id", list(MODELS)))


@query("agg_predictions_long", with_scored("SELECT model, count(*) AS rows, round(sum(predicted) / 1000, 2) AS total_thousands FROM scored GROUP BY 1"))
def _(spark, sf):
    wide = stats.wide_predictions(scored(spark, sf), "listing_id", list(MODELS))
    long = stats.long_predictions(wide, "listing_id", list(MODELS))
    return rounded(long.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), (F.sum("predicted") / 1000).alias("total_thousands")), 2)


# --- ranks and sets --------------------------------------------------------

METRICS = "count(*) AS n, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual)) AS mae, 1 - sum((predicted - actual) * (predicted - actual)) / (var_pop(actual) * count(*)) AS r2"
REPORT = f", report AS (SELECT model, {METRICS} FROM scored GROUP BY 1), by_state AS (SELECT state, model, {METRICS} FROM scored GROUP BY 1, 2), by_fold AS (SELECT model, fold, {METRICS} FROM scored GROUP BY 1, 2)"


def report(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    extra = [c for c in by if c not in ("model", "fold")]
    return scored(spark, sf, extra).groupBy(*by).agg(*evaluate.core_metrics())


@query("rank_metric", with_scored(REPORT + " SELECT state, model, round(rmse, 4) AS rmse, rank() OVER (PARTITION BY state ORDER BY rmse) AS rmse_rank, rank() OVER (PARTITION BY state ORDER BY r2 DESC) AS r2_rank FROM by_state"))
def _(spark, sf):
    ranked = windows.rank_min(report(spark, sf, "state", "model"), "rmse", ["state"])
    return rounded(windows.rank_min(ranked, "r2", ["state"], descending=True).select("state", "model", "rmse", "rmse_rank", "r2_rank"))


@query("rank_group_size", with_listings("SELECT listing_id, count(*) OVER (PARTITION BY building_name, tenure_type) AS group_size FROM listings"))
def _(spark, sf):
    return windows.group_size(listings(spark, sf, ["listing_id", "building_name", "tenure_type"]), ["building_name", "tenure_type"]).select("listing_id", "group_size")


@query("rank_candidates", with_scored(REPORT + " SELECT model, row_number() OVER (ORDER BY rmse, mae, r2 DESC, model) AS rank, CAST(row_number() OVER (ORDER BY rmse, mae, r2 DESC, model) = 1 AS INTEGER) AS selected FROM report"))
def _(spark, sf):
    return windows.candidate_rank(report(spark, sf, "model"), "model").select("model", "rank", "selected")


@query("rank_best_row", with_scored(REPORT + " SELECT state, model FROM by_state ORDER BY rmse, r2 DESC LIMIT 1"))
def _(spark, sf):
    return windows.best_row(report(spark, sf, "state", "model"), [F.asc("rmse"), F.desc("r2")]).select("state", "model")


@query("rank_combined_best", with_scored(REPORT + " SELECT model, rank() OVER (ORDER BY rmse) + rank() OVER (ORDER BY mae) AS combined_rank FROM report ORDER BY 2, 1 LIMIT 1"))
def _(spark, sf):
    return windows.combined_rank_best(report(spark, sf, "model"), "model").select("model", F.col("combined_rank").cast("long").alias("combined_rank"))


@query("rank_top_n", with_listings("SELECT listing_id, price FROM listings ORDER BY price DESC, listing_id LIMIT 25"))
def _(spark, sf):
    return windows.top_n(listings(spark, sf, ["listing_id", "price"]), "price", 25, "listing_id")


@query("rank_stable_sort", with_scored(REPORT + " SELECT model, fold, round(rmse, 4) AS rmse FROM by_fold ORDER BY model, rmse, fold"))
def _(spark, sf):
    return rounded(windows.sort_stable(report(spark, sf, "model", "fold"), ["model", F.asc("rmse")], "fold").select("model", "fold", "rmse"))


@query("rank_cumulative_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS cumulative FROM orders")
def _(spark, sf):
    out = windows.cumulative_sum(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")
    return rounded(out.select("o_orderkey", "cumulative"), 2)


@query("rank_delta_vs_baseline", with_scored(REPORT + ", f AS (SELECT model, fold, rmse, mae, max(rmse) FILTER (WHERE fold = 1) OVER (PARTITION BY model) AS br, max(mae) FILTER (WHERE fold = 1) OVER (PARTITION BY model) AS bm FROM by_fold)"
       " SELECT model, fold, round(rmse - br, 4) AS rmse_change, round((rmse - br) / br * 100, 4) AS rmse_change_pct, round(mae - bm, 4) AS mae_change, round((mae - bm) / bm * 100, 4) AS mae_change_pct FROM f"))
def _(spark, sf):
    out = windows.delta_vs_baseline(report(spark, sf, "model", "fold"), ["model"], "fold", 1, ["rmse", "mae"])
    return rounded(out.select("model", "fold", "rmse_change", "rmse_change_pct", "mae_change", "mae_change_pct"))


@query("rank_fold_wins", with_scored(REPORT + " SELECT count(*) FILTER (WHERE a.rmse < b.rmse) AS rmse_wins, count(*) FILTER (WHERE a.mae < b.mae) AS mae_wins, count(*) AS folds FROM by_fold a JOIN by_fold b USING (fold) WHERE a.model = 'model_b' AND b.model = 'model_a'"))
def _(spark, sf):
    return windows.fold_wins(report(spark, sf, "model", "fold"), "model", "model_b", "model_a", ["rmse", "mae"])


@query("rank_balanced_score", with_scored(REPORT + " SELECT r.model, round(r.rmse / b.rmse + r.mae / b.mae, 6) AS balanced_score FROM report r, report b WHERE b.model = 'model_a' ORDER BY 2, 1 LIMIT 1"))
def _(spark, sf):
    rep = report(spark, sf, "model")
    best = windows.balanced_score_best(rep, rep.where("model = 'model_a'"), ["rmse", "mae"], "model")
    return rounded(best.select("model", "balanced_score"), 6)


@query("set_union_long", "SELECT doc_id, lang, n_chars, NULL::BIGINT AS turn FROM documents UNION ALL SELECT conv_id, NULL, NULL, turn FROM conversations")
def _(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    b = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    return windows.union_long(a, b)


@query("set_id_overlap", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS union_ids,"
       " (SELECT count(*) FROM a JOIN b USING (k)) AS common_ids, (SELECT count(*) FROM a WHERE k NOT IN (FROM b)) AS left_only_ids, (SELECT count(*) FROM b WHERE k NOT IN (FROM a)) AS right_only_ids")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return windows.id_overlap(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "k")


# --- folds -----------------------------------------------------------------

FOLDED = f", f AS (SELECT *, {sql_fold('listing_id', 5, 42)} AS gfold FROM listings)"
COPIES = ", t AS (SELECT f.*, o.k AS outer_fold FROM f JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) o ON f.gfold <> o.k)"
TRIMS = "(VALUES ('A', 0.0), ('B', 0.5), ('C', 1.0), ('D', 2.5), ('E', 5.0), ('F', 10.0)) lv(trim_level, removal_pct)"


def with_folds(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return folds.assign_group_kfold(listings(spark, sf, ["listing_id", *columns]), "listing_id")


@query("fold_balanced", with_listings("SELECT listing_id, CAST((row_number() OVER (ORDER BY md5('42:' || listing_id)) - 1) % 5 + 1 AS INTEGER) AS fold FROM listings"))
def _(spark, sf):
    return folds.assign_kfold(listings(spark, sf, ["listing_id"]), "listing_id")


@query("fold_by_group", f"SELECT doc_id, source, {sql_fold('source', 5, 42)} AS fold FROM documents")
def _(spark, sf):
    return folds.assign_group_kfold(table(spark, sf, "documents").select("doc_id", "source"), "source")


BALANCED = """{groups} AS (SELECT {key} AS k, row_number() OVER (ORDER BY count(*) DESC, md5('42:' || CAST({key} AS VARCHAR))) - 1 AS turn FROM listings GROUP BY {key})"""
DEALT = "CAST(CASE WHEN turn % 10 < 5 THEN turn % 10 + 1 ELSE 10 - turn % 10 END AS INTEGER)"


@query("fold_by_group_balanced", with_listings(f", {BALANCED.format(groups='g', key='building_name')} SELECT listing_id, building_name, {DEALT} AS fold FROM listings JOIN g ON building_name = k"))
def _(spark, sf):
    return folds.assign_group_kfold_balanced(listings(spark, sf, ["listing_id", "building_name"]), "building_name")


@query("fold_balance_many_groups", with_listings(f""", orders_of AS (SELECT split_part(listing_id, '-', 1) AS order_key FROM listings), g AS (SELECT order_key AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5('42:' || order_key)) - 1 AS turn FROM orders_of GROUP BY order_key)
 SELECT {DEALT} AS fold, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(max(n) AS BIGINT) AS largest FROM g GROUP BY 1"""))
def _(spark, sf):
    """As many groups as orders; the folds differ by no more than the largest group."""
    rows = listings(spark, sf, ["listing_id"]).select(F.split_part("listing_id", F.lit("-"), F.lit(1)).alias("order_key"))
    dealt = folds.assign_group_kfold_balanced(rows, "order_key").groupBy("fold", "order_key").agg(F.count(F.lit(1)).alias("n"))
    return dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


@query("fold_nested", with_listings(FOLDED + COPIES + f" SELECT listing_id, CAST(outer_fold AS INTEGER) AS outer_fold, {sql_fold(chr(39) + chr(39) + ' || outer_fold || ' + chr(39) + '|' + chr(39) + ' || listing_id', 3, 43)} AS inner_fold FROM t"))
def _(spark, sf):
    return folds.inner_folds(with_folds(spark, sf), "listing_id", 3, 42).select("listing_id", "outer_fold", "inner_fold")


@query("fold_train_test", with_listings(f"SELECT listing_id, CASE WHEN {sql_hash('listing_id', 42)} < 858993459 THEN 'test' ELSE 'train' END AS split FROM listings"))
def _(spark, sf):
    return folds.train_test_split(listings(spark, sf, ["listing_id"]), "listing_id")


@query("fold_retained_cv", with_listings(
    FOLDED + f", c AS (SELECT trim_level, removal_pct, CASE WHEN removal_pct > 0 THEN (SELECT quantile_cont(price, [0.995, 0.99, 0.975, 0.95, 0.9]) FROM f)[CASE trim_level WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 WHEN 'E' THEN 4 ELSE 5 END] END AS cut FROM {TRIMS}),"
    " g AS (SELECT trim_level, removal_pct, gfold AS fold, count(*) AS o, count(*) FILTER (WHERE cut IS NULL OR price <= cut) AS r FROM f CROSS JOIN c GROUP BY 1, 2, 3)"
    " SELECT trim_level, CAST(removal_pct AS DOUBLE) AS removal_pct, fold, o AS original_rows, r AS retained_rows, o - r AS removed_rows, CAST(sum(r) OVER (PARTITION BY trim_level) - r AS BIGINT) AS training_rows, r AS validation_rows, round(r * 100.0 / o, 4) AS retention_pct FROM g"))
def _(spark, sf):
    return rounded(folds.retained_cv_summary(with_folds(spark, sf, "price"), "price"))


@query("fold_tail_trim_cutoffs", with_listings(
    FOLDED + COPIES + f", q AS (SELECT outer_fold, quantile_cont(price, [0.995, 0.99, 0.975, 0.95, 0.9]) AS c FROM t GROUP BY 1), c AS (SELECT outer_fold, trim_level, removal_pct, CASE WHEN removal_pct > 0 THEN c[CASE trim_level WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 WHEN 'E' THEN 4 ELSE 5 END] END AS cut FROM q CROSS JOIN {TRIMS}),"
    " g AS (SELECT trim_level, removal_pct, outer_fold, count(*) AS b, count(*) FILTER (WHERE cut IS NOT NULL AND price > cut) AS rm, count(*) FILTER (WHERE cut IS NULL OR price <= cut) AS kp, max(cut) AS cutoff, max(price) FILTER (WHERE cut IS NULL OR price <= cut) AS mx FROM t JOIN c USING (outer_fold) GROUP BY 1, 2, 3), v AS (SELECT gfold, count(*) AS n FROM f GROUP BY 1)"
    " SELECT trim_level, CAST(removal_pct AS DOUBLE) AS removal_pct, CAST(outer_fold AS INTEGER) AS fold, b AS training_rows_before, rm AS training_rows_removed, kp AS training_rows_retained, round(rm * 100.0 / b, 6) AS actual_removal_pct, round(cutoff, 6) AS cutoff, mx AS max_retained, n AS validation_rows, 0 AS validation_rows_removed FROM g JOIN v ON gfold = outer_fold"))
def _(spark, sf):
    return rounded(folds.tail_trim_cutoffs(with_folds(spark, sf, "price"), "price"), 6)


@query("fold_population_trim", with_listings(
    f", c AS (SELECT trim_level, removal_pct, CASE WHEN removal_pct > 0 THEN (SELECT quantile_cont(price, [0.995, 0.99, 0.975, 0.95, 0.9]) FROM listings)[CASE trim_level WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 WHEN 'E' THEN 4 ELSE 5 END] END AS cut FROM {TRIMS})"
    " SELECT trim_level, round(max(cut), 4) AS cutoff, count(*) AS rows, count(*) FILTER (WHERE cut IS NULL OR price <= cut) AS retained FROM listings CROSS JOIN c GROUP BY 1"))
def _(spark, sf):
    flagged = folds.population_trim(listings(spark, sf, ["price"]), "price")
    return rounded(flagged.groupBy("trim_level").agg(F.max("cutoff").alias("cutoff"), F.count(F.lit(1)).alias("rows"), F.sum("retained").alias("retained")))


_WINSOR = " UNION ALL ".join(
    f"SELECT '{n}' AS setting, outer_fold, {f'quantile_cont(unit_price, {lo})' if lo is not None else 'NULL'} AS lo, quantile_cont(unit_price, {hi}) AS hi FROM t GROUP BY 2" for n, lo, hi in folds.WINSOR_SETTINGS)


@query("fold_winsor_bounds", with_listings(
    FOLDED + COPIES + f", b AS ({_WINSOR}) SELECT setting, CAST(outer_fold AS INTEGER) AS fold, round(max(lo), 6) AS lower_bound, round(max(hi), 6) AS upper_bound, count(*) FILTER (WHERE unit_price < lo) AS lower_clipped, count(*) FILTER (WHERE unit_price > hi) AS upper_clipped, count(*) AS training_rows FROM t JOIN b USING (outer_fold) GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(folds.winsor_bounds(with_folds(spark, sf, "unit_price"), "unit_price"), 6)


@query("fold_winsorize", with_listings(
    FOLDED + COPIES + ", b AS (SELECT outer_fold, quantile_cont(unit_price, 0.05) AS lo, quantile_cont(unit_price, 0.95) AS hi FROM t GROUP BY 1) SELECT CAST(outer_fold AS INTEGER) AS outer_fold, listing_id, round(least(greatest(unit_price, lo), hi), 9) AS unit_price_clipped FROM t JOIN b USING (outer_fold)"))
def _(spark, sf):
    return rounded(folds.winsorize(with_folds(spark, sf, "unit_price"), "unit_price", 0.05, 0.95).select("outer_fold", "listing_id", "unit_price_clipped"), 9)


@query("fold_premium_labels", with_listings(
    FOLDED + COPIES + ", b AS (SELECT outer_fold, quantile_cont(price, 0.9) AS q FROM t GROUP BY 1) SELECT CAST(outer_fold AS INTEGER) AS outer_fold, CASE WHEN gfold = outer_fold THEN 'validation' ELSE 'train' END AS role, CAST(price >= q AS INTEGER) AS is_premium, count(*) AS rows, round(max(q), 4) AS threshold FROM f CROSS JOIN b GROUP BY 1, 2, 3"))
def _(spark, sf):
    out = folds.fold_premium_labels(with_folds(spark, sf, "price"), "price", 0.9)
    return rounded(out.groupBy("outer_fold", "role", "is_premium").agg(F.count(F.lit(1)).alias("rows"), F.max("threshold").alias("threshold")))
