"""Exact duplicates by a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import WHITE, body, written

#: A digest that holds more than this share of the rows is never shuffled.
SUPPORT = 0.002


def digest() -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(body(), f"{WHITE}+", ""), 256)


def rank() -> Column:
    """Sorts the row that stays first: most code points, then smallest ``doc_id``, unnumbered rows last."""
    return F.struct((-F.char_length(body())).alias("size"), F.col("doc_id").isNull().alias("unnumbered"), F.col("doc_id").alias("doc_id"))


def heavy_winners(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests that may hold over ``support`` of the rows, with their exact size and first row.

    ``freqItems`` is the Misra-Gries summary: it has at most ``1 / support``
    counters, misses no digest above the support and may name others. The
    second pass verifies every candidate with exact, map-side combined figures,
    so a false candidate does no harm. At most ``1 / support`` rows.
    """
    found = keyed.freqItems(["text_sha256"], support).first()[0] or []
    spark = keyed.sparkSession
    named = spark.createDataFrame([(d,) for d in found], "text_sha256 string")
    exact = keyed.join(F.broadcast(named), "text_sha256", "left_semi").groupBy("text_sha256").agg(
        F.min("rank").alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    rows = exact.where("group_size > 1").collect()
    return spark.createDataFrame(rows, exact.schema)


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Texts are equal when they agree after white space is deleted; null counts
    as empty. Of equal texts the one with the most code points stays, then the
    smallest ``doc_id``. A repeated row is reported as often as it comes; its
    ``kept`` follows its ``doc_id``. A null ``doc_id`` stays only where all
    its copies have none. Extra columns are ignored; an empty table gives none.

    The digest table (some 50 bytes a row) is written once. Heavy digests meet
    their winners in a broadcast join and never move; the others are grouped
    by one ordinary shuffle, where no digest exceeds ``support``.
    """
    keyed = written(docs.select("doc_id", digest().alias("text_sha256"), rank().alias("rank")), "digests")
    winners = F.broadcast(heavy_winners(keyed, support))
    hot = keyed.join(winners, "text_sha256")
    group = W.partitionBy("text_sha256")
    cold = keyed.join(winners, "text_sha256", "left_anti").select(
        "*", F.min("rank").over(group).alias("first"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return hot.unionByName(cold).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one.

    Copies of heavy digests are removed on the map side, before the only
    shuffle; their winners go through it with the other rows.
    """
    keyed = written(docs.select("doc_id", digest().alias("text_sha256"), rank().alias("rank")), "digests")
    winners = heavy_winners(keyed, support).select(F.col("text_sha256").alias("_hot"), F.col("first").alias("_first"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), digest().alias("_digest"), rank().alias("_rank"))
    met = rows.join(F.broadcast(winners), F.col("_digest") == F.col("_hot"), "left")
    left = met.where(F.col("_hot").isNull() | F.col("_rank").eqNullSafe(F.col("_first")))
    order = W.partitionBy("_digest").orderBy("_rank", F.xxhash64("_row"))
    return left.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_row.*")
