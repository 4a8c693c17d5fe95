"""Repeat groups: the summary lists its members, and ids stay distinct above four digits."""

from pyspark.sql import functions as F

from terrace.operators import dedup


def test_summary_lists_every_member_in_order(spark):
    rows = [(10, "g1", 1, 1), (9, "g1", 1, 2), (100, "g1", None, 1), (4, "g2", 7, 1), (3, "g2", None, 1), (5, "", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, repeat_group_id string, level_1 long, fold int")
    found = {r.repeat_group_id: r for r in dedup.repeat_group_summary(df, ["level_1"], "doc_id", "fold").collect()}
    assert {g: r.members for g, r in found.items()} == {"g1": "9|10|100", "g2": "3|4"}
    assert (found["g1"].size, found["g1"].folds, found["g1"].crosses_folds, found["g1"].groups_level_1) == (3, "1|2", 1, 1)


def test_group_ids_above_9999_stay_distinct(spark):
    df = spark.range(20_020).select(F.col("id").alias("doc_id"), (F.col("id") - F.col("id") % 2).alias("component"))
    named = dedup.number_groups(df, "B", "doc_id")
    ids = {r.repeat_group_id for r in named.select("repeat_group_id").distinct().collect()}
    assert len(ids) == 10_010 and {"B_RG_0001", "B_RG_9999", "B_RG_10000", "B_RG_10010"} <= ids
