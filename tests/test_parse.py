"""Literal fixtures of the parsing functions."""

from pyspark.sql import functions as F

from terrace.functions import flags, parse


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_prices_and_sizes(spark):
    prices = values(spark, ["RM 340 000", "RM340,000", "RM 1 250 000", "-"], parse.extract_price_decimal)
    assert prices == [340000.0, 340000.0, 1250000.0, None]
    assert values(spark, ["RM 1.50"], parse.extract_price) == [150.0]
    assert values(spark, ["1000 sq.ft.", "1,200 sq.ft.", "bad", "0 sqft"], parse.parse_size) == [1000.0, 1200.0, None, None]
    assert values(spark, ["about -3.5 m"], parse.extract_signed_number) == [-3.5]


def test_tokens_presence_and_space(spark):
    tokens = lambda c: parse.count_distinct_tokens(c, parse.MISSING_MARKERS)
    assert values(spark, ["Pool, Gym, pool, -", None], tokens) == [2, 0]
    assert values(spark, ["School", "-", None], parse.any_recorded) == [1, 0, 0]
    assert values(spark, ["a  b ", None], parse.collapse_whitespace) == ["a b", "Unknown"]
    assert values(spark, ["Unfurnished"], lambda c: parse.regex_flag(c, "furnished|furnishing")) == [1]


def test_condition_words(spark):
    texts = ["Fully furnished with fridge", "Renovated kitchen cabinets", None]
    furnished = values(spark, texts, lambda c: parse.regex_flag(c, flags.FURNISHED_WORDS))
    renovated = values(spark, texts, lambda c: parse.regex_flag(c, flags.RENOVATED_WORDS))
    assert (furnished, renovated) == ([1, 0, 0], [0, 1, 0])
    assert values(spark, [None], parse.text_length) == [0]


def test_places(spark):
    rows = ["Jalan Besar, Johor", "12, Air Itam, Pulau Pinang", None, " ", "Kuala Lumpur City", "45000, Klang, Selangor"]
    assert values(spark, rows, parse.extract_city) == ["Johor", "Ayer Itam", "Unknown", "Unknown", "Kuala Lumpur", "Klang"]
    assert values(spark, rows[:2], parse.extract_state) == ["Johor", "Penang"]


def test_amounts_in_text(spark):
    text = ["Selling 850 sq ft RM 450k and 1,200 sqft RM1.2m, 12 sqft"]
    assert values(spark, text, parse.extract_all_sizes) == [[850.0, 1200.0]]
    assert values(spark, text, parse.extract_all_prices) == [[450000.0, 1200000.0]]


def test_flag_patterns(spark):
    df = spark.createDataFrame([("High  Floor unit, balconies",), ("highfloor balcony",), (None,)], "t string")
    rows = flags.regex_flag_set(df, "t", flags.POSITION_FLAGS).collect()
    assert [(r["is_high_floor_text"], r["has_balcony"]) for r in rows] == [(1, 1), (0, 1), (0, 0)]
    assert len(flags.ALL_FLAGS) == 44


def test_null_correction_wins(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "k long, v double")
    fixes = spark.createDataFrame([(1, None), (2, 9.0)], "key long, value double")
    out = {r["k"]: r["v"] for r in parse.apply_corrections(df, fixes, "k", "v").collect()}
    assert out == {1: None, 2: 9.0, 3: 7.0}
