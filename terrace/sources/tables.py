"""Readers, writers and table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Columns a raw listings file must have.
REQUIRED_RAW_COLUMNS = (
    "Ad List", "price", "Property Size", "Bedroom", "Bathroom", "Parking Lot", "Completion Year",
    "# of Floors", "Total Units", "Property Type", "Tenure Type", "Land Title", "Floor Range",
    "Address", "Facilities", "Nearby School", "School", "Nearby Mall", "Mall", "Hospital",
    "Nearby Railway Station", "Railway Station", "Bus Stop", "Park", "Highway",
)
DESCRIPTIVE_COLUMNS = ("description", "Building Name", "Developer")
RAW_SCHEMA = StructType([StructField(c, StringType()) for c in (*REQUIRED_RAW_COLUMNS, *DESCRIPTIVE_COLUMNS)])


def read_listings(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Headered CSV with quoted multi-line text, plus a dense ``row_seq``.

    Without a schema every column is text and named by the header; a schema
    such as ``RAW_SCHEMA`` must list the file's columns exactly. Positions follow file order. Each file's start is the row count of the
    files before it; inside a file the reader's own increasing id decides, so
    rows are never sorted.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    rows = (
        reader.csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # One row per input file.
    ahead = Window.partitionBy(F.lit(1)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        rows.groupBy("_file")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
        .drop("_rows")
    )
    return (
        rows.join(files, "_file")
        .withColumn("row_seq", F.col("_start") + F.col("_id") - F.col("_first"))
        .drop("_file", "_id", "_first", "_start")
    )


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Projected Parquet scan."""
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown table kind: {kind}")


def json_ready(df: DataFrame) -> DataFrame:
    """Non-finite doubles become NULL, as JSON has no spelling for them."""
    def clean(name: str, kind: str):
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        return c.alias(name)

    return df.select(*[clean(n, k) for n, k in df.dtypes])


def write_report_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_ready(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def table_fingerprint(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Order-independent content hash: row count, xor and sum of row hashes."""
    columns = sorted(keys or df.columns)
    row = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return df.select(row.alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("_h").alias("hash_xor"),
        F.sum(F.col("_h").cast("decimal(38,0)")).alias("hash_sum"),
    )
