"""Listings-shaped tables derived from a star schema, for the query catalogue.

``columns`` prunes whole joins: a query that needs no order attribute does not
join ``orders``. Dimension keys are unique and complete, so the left joins
neither drop nor multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FROM_PART = {"property_type": "p_type", "building_name": "p_brand"}
_PLACES = ("developer", "city", "state")
_FROM_ORDERS = ("floor_range", "completion_year")
ALL_COLUMNS = (
    "listing_id", "price", "property_size_sqft", "property_type", "building_name", "developer", "city",
    "state", "tenure_type", "land_title", "floor_range", "bedroom", "bathroom", "parking_lot",
    "completion_year", "number_of_floors", "total_units", "unit_price",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    wanted = list(columns or ALL_COLUMNS)
    need = set(wanted)
    rows = table(spark, sf_dir, "lineitem")
    if need & {"property_type", "building_name", "number_of_floors"}:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if need & set(_PLACES):
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        if need & {"city", "state"}:
            supplier = supplier.join(
                table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left"
            )
        if "state" in need:
            supplier = supplier.join(
                table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
            )
        rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if need & set(_FROM_ORDERS):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    forms = {
        "listing_id": F.concat_ws(
            "-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd"),
        ),
        "price": F.col("l_extendedprice"),
        "property_size_sqft": F.col("l_quantity"),
        "property_type": F.col("p_type") if "property_type" in need else None,
        "building_name": F.col("p_brand") if "building_name" in need else None,
        "developer": F.when(F.col("l_suppkey") % 17 != 0, F.col("s_name")) if "developer" in need else None,
        "city": F.col("n_name") if "city" in need else None,
        "state": F.col("r_name") if "state" in need else None,
        "tenure_type": F.col("l_returnflag"),
        "land_title": F.col("l_linestatus"),
        "floor_range": F.col("o_orderpriority") if "floor_range" in need else None,
        "bedroom": F.col("l_linenumber"),
        "bathroom": F.round(F.col("l_tax") * 100).cast("int"),
        "parking_lot": F.round(F.col("l_discount") * 100).cast("int"),
        "completion_year": F.when(F.col("l_orderkey") % 13 != 0, F.year("o_orderdate"))
        if "completion_year" in need else None,
        "number_of_floors": F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
        if "number_of_floors" in need else None,
        "total_units": F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") % 997),
        "unit_price": F.col("l_extendedprice") / F.col("l_quantity"),
    }
    return rows.select(*[forms[c].alias(c) for c in wanted])


MODELS = ("model_a", "model_b", "model_c", "model_d")


def scored(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Long out-of-fold surrogate: one row per model and listing.

    Predictions are a fixed arithmetic function of the price and keys; folds
    come from an md5 of the listing key.
    """
    base = listings(spark, sf_dir, list(dict.fromkeys(["listing_id", "price", "bedroom", "bathroom", "parking_lot", *(columns or [])])))
    digest = F.md5("listing_id")
    fold = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 5 + 1).cast("int")
    wobble = F.conv(F.substring(digest, 9, 6), 16, 10).cast("long")
    shapes = [
        F.struct(
            F.lit(m).alias("model"),
            (F.col("price") * (1 + ((F.col("_w") * (7 + 4 * i)) % 41 - 19 - i) / F.lit(100.0))).alias("predicted"),
        )
        for i, m in enumerate(MODELS)
    ]
    kept = columns or []
    return (
        base.withColumn("fold", fold)
        .withColumn("_w", wobble)
        .withColumn("_m", F.explode(F.array(*shapes)))
        .select(
            F.col("_m.model").alias("model"), "listing_id", "fold",
            F.col("price").alias("actual"), F.col("_m.predicted").alias("predicted"), *kept,
        )
    )


# Phrases of surrogate descriptions, by (column of the listing, modulus, remainder).
PHRASES = (
    ("bedroom", 3, 0, "High floor unit"), ("bedroom", 5, 1, "Low Floor"), ("bathroom", 4, 2, "top  floor home"), ("parking_lot", 3, 1, "with balcony"),
    ("parking_lot", 7, 4, "and a large balcony"), ("bathroom", 7, 5, "two balconies"),
)


def described(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Listings with a ``description`` that Spark derives from their columns; every ninth key has none."""
    need = dict.fromkeys(["listing_id", "price", "property_size_sqft", "bedroom", "bathroom", "parking_lot", "property_type", "city", *(columns or [])])
    rows = listings(spark, sf_dir, list(need))
    parts = [F.when(F.col(c) % m == r, F.lit(text)) for c, m, r, text in PHRASES]
    said = F.concat_ws(", ", F.col("property_type"), *parts, F.initcap("city"))
    blank = F.conv(F.substring(F.md5("listing_id"), 1, 8), 16, 10).cast("long") % 9 == 0
    return rows.withColumn("description", F.when(blank, F.lit("  ")).otherwise(said))
