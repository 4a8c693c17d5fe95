"""Parsing and normalisation of noisy text and numbers (Column expressions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Textual markers that mean "missing".
MISSING_MARKERS = ("", "-", "--", "n/a", "na", "nan", "none", "null", "unknown")
# Markers that mean "nothing recorded" for an amenity column.
BLANK_MARKERS = ("", "-", "nan", "none")
# State names in match order.
STATES = (
    "Kuala Lumpur", "Negeri Sembilan", "Pulau Pinang", "Penang", "Malacca", "Melaka",
    "Selangor", "Johor", "Sabah", "Sarawak", "Putrajaya", "Perak", "Pahang", "Kedah",
    "Terengganu", "Kelantan", "Labuan",
)
# Spelling aliases.
STATE_ALIASES = {"Pulau Pinang": "Penang", "Malacca": "Melaka"}
CITY_ALIASES = {
    "air itam": "Ayer Itam",
    "ayer itam": "Ayer Itam",
    "georgetown": "George Town",
    "george town": "George Town",
}
FEDERAL_TERRITORIES = ("Kuala Lumpur", "Putrajaya", "Labuan")
STREET_PREFIXES = ("jalan ", "jln ", "lorong ", "persiaran ", "off ")
# Verified corrections by listing key.
PRICE_CORRECTIONS = {103798808: 480000.0}
SIZE_CORRECTIONS = {
    103423738: 991.0,
    103788197: 850.0,
    101812262: 1227.74,
    102897216: 1450.0,
    103729938: None,
}

UNSET = "__MISSING__"
_EDGE_SPACE = r"(?U)^\s+|\s+$"
_SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Trim every Unicode whitespace character, not only the space."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def one_of(c: Column, values) -> Column:
    return c.isin(*values)


def as_number(c: Column) -> Column:
    return c.try_cast("double")


def standardize_missing(df: DataFrame, markers=MISSING_MARKERS) -> DataFrame:
    """Trim every string column and turn missing markers into NULL."""
    def clean(name: str) -> Column:
        text = strip(F.col(name))
        return F.when(~F.lower(text).isin(*markers), text).alias(name)

    return df.select(*[clean(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def is_missing(df: DataFrame, name: str, markers=MISSING_MARKERS) -> Column:
    """Semantic missing test: marker text, or NULL / NaN / infinite number."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind == "string":
        return c.isNull() | F.lower(strip(c)).isin(*markers)
    if kind in ("double", "float"):
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return c.isNull()


def extract_number(c: Column) -> Column:
    """First unsigned number once thousands commas are gone."""
    found = F.regexp_extract(F.regexp_replace(c, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return as_number(F.nullif(found, F.lit("")))


def extract_signed_number(c: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(c, ",", ""), r"([-+]?[0-9]*\.?[0-9]+)", 1)
    return as_number(F.nullif(found, F.lit("")))


def extract_price(c: Column) -> Column:
    """All digits of the text read as one integer."""
    return as_number(F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")))


def null_if_nonpositive(c: Column) -> Column:
    return F.when(c > 0, c)


def extract_price_decimal(c: Column) -> Column:
    digits = F.nullif(F.regexp_replace(c, "[^0-9.]", ""), F.lit(""))
    return null_if_nonpositive(as_number(digits))


def parse_size(c: Column) -> Column:
    return null_if_nonpositive(extract_number(c))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: as_number(strip(F.col(c))) for c in columns})


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where ``key`` has a correction; a NULL correction wins.

    ``corrections`` has columns ``key`` and ``value``. It is a curated list and
    the join strategy is left to the optimizer.
    """
    fixes = corrections.select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.lit(1).alias("_hit"))
    joined = df.join(fixes, F.col(key) == F.col("_key"), "left")
    fixed = F.when(F.col("_hit") == 1, F.col("_value")).otherwise(F.col(column))
    return joined.withColumn(column, fixed).drop("_key", "_value", "_hit")


def collapse_whitespace(c: Column, fill: str | None = "Unknown") -> Column:
    text = strip(F.regexp_replace(c, _SPACES, " "))
    return text if fill is None else F.coalesce(text, F.lit(fill))


def normalize_text(c: Column) -> Column:
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return strip(F.regexp_replace(lowered, _SPACES, " "))


def extract_state(address: Column) -> Column:
    """First listed state named in the address as whole words.

    One pass finds a name at every place (the look-ahead lets names overlap);
    the one that the list has first wins.
    """
    found = F.regexp_extract_all(address, F.lit(rf"(?i)\b(?=({'|'.join(STATES)})\b)"), F.lit(1))
    known = F.array(*[F.lit(s.lower()) for s in STATES])
    first = F.array_min(F.transform(found, lambda x: F.array_position(known, F.lower(x)))).cast("int")
    return F.coalesce(F.get(F.array(*[F.lit(STATE_ALIASES.get(s, s)) for s in STATES]), first - 1), F.lit("Unknown"))


def extract_city(address: Column) -> Column:
    """Locality label: last address part that is neither a state nor a number."""
    text = strip(F.regexp_replace(address, _SPACES, " "))
    names = [s.lower() for s in STATES]
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    alias = F.create_map(*[F.lit(x) for pair in CITY_ALIASES.items() for x in pair])

    def choose(found: Column) -> Column:
        state, count, places = found["state"], F.size(found["parts"]), found["places"]
        city = F.try_element_at(places, F.lit(-1))
        is_street = reduce(lambda a, b: a | b, [F.lower(city).startswith(p) for p in STREET_PREFIXES])
        return (
            F.when(state.isin(*FEDERAL_TERRITORIES), state)
            .when(F.size(places) == 0, state)
            .when((count <= 2) & is_street, state)
            .otherwise(F.coalesce(F.try_element_at(alias, F.lower(city)), city))
        )

    # State and parts are found once and named in the rule.
    places = F.filter(parts, lambda p: ~F.lower(p).isin(*names) & ~p.rlike(r"^[0-9]+$"))
    found = F.struct(extract_state(text).alias("state"), parts.alias("parts"), places.alias("places"))
    chosen = F.get(F.transform(F.array(found), choose), F.lit(0))
    return F.when(text.isNull() | (text == ""), F.lit("Unknown")).otherwise(chosen)


def text_length(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def range_guard(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside an inclusive range become NULL."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items()})


def count_distinct_tokens(c: Column, drop_markers=()) -> Column:
    """Distinct non-empty comma-separated tokens; NULL and ``unknown`` give 0."""
    tokens = F.transform(F.split(c, ","), lambda t: F.lower(strip(t)))
    ignored = ["", *drop_markers]
    kept = F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*ignored)))
    empty = c.isNull() | F.lower(strip(c)).isin("", "unknown")
    return F.when(empty, F.lit(0)).otherwise(F.size(kept))


def any_recorded(*columns: Column, markers=BLANK_MARKERS) -> Column:
    """1 when any source column holds something other than a blank marker."""
    present = [F.coalesce(~F.lower(strip(c)).isin(*markers), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, present).cast("int")


def contains_flag(c: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(part)).cast("int")


def regex_flag(c: Column, pattern: str) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike(pattern).cast("int")


# Pattern of a size and of a currency amount inside free text.
SIZE_IN_TEXT = r"(?i)(?<![0-9])([0-9]{3,5}(?:\.[0-9]+)?)\s*(?:sq\.?\s*ft|sqft|sft|sf)\b"
PRICE_IN_TEXT = r"(?i)\brm\s*([0-9]+(?:\.[0-9]+)?)\s*([km]?)\b"


def extract_all_sizes(c: Column) -> Column:
    """Sorted distinct square-foot figures between 100 and 20,000."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), ",", "")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(SIZE_IN_TEXT), F.lit(1)), lambda n: n.cast("double"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(100, 20000))))


def extract_all_prices(c: Column) -> Column:
    """Sorted distinct currency amounts of at least 30,000, suffixes applied."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), ",", "")
    numbers = F.regexp_extract_all(text, F.lit(PRICE_IN_TEXT), F.lit(1))
    suffixes = F.regexp_extract_all(text, F.lit(PRICE_IN_TEXT), F.lit(2))

    def scaled(number: Column, suffix: Column) -> Column:
        scale = F.when(F.lower(suffix) == "k", 1e3).when(F.lower(suffix) == "m", 1e6).otherwise(1.0)
        return number.cast("double") * scale

    amounts = F.zip_with(numbers, suffixes, scaled)
    return F.array_sort(F.array_distinct(F.filter(amounts, lambda a: a >= 30000)))


def text_supports_count(c: Column, count: Column, noun: str) -> Column:
    """Whether the text states this row's own count next to the noun."""
    number = count.cast("long").cast("string")
    before = F.concat(F.lit(r"(?i)\b"), number, F.lit(rf"\s*[- ]?{noun}\b"))
    after = F.concat(F.lit(rf"(?i)\b{noun}\s*[:\-]?\s*"), number, F.lit(r"\b"))
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(F.rlike(text, before) | F.rlike(text, after), F.lit(False))


def band(c: Column, edges: list[float], labels: list[str], right_closed: bool = True, missing: str | None = UNSET) -> Column:
    """Label of the bin a number falls in; ``labels`` has one more entry than ``edges``."""
    result = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(missing))
    for edge, label in zip(edges, labels):
        inside = c <= edge if right_closed else c < edge
        result = result.when(inside, F.lit(label))
    return result.otherwise(F.lit(labels[-1]))


def combine_keys(*columns: Column) -> Column:
    return F.concat_ws("__", *[F.coalesce(c.cast("string"), F.lit(UNSET)) for c in columns])


def ratio(numerator: Column, denominator: Column, positive_only: bool = False) -> Column:
    """Quotient that is NULL for a missing, zero or non-finite divisor."""
    quotient = finite(F.try_divide(numerator.cast("double"), denominator.cast("double")))
    return null_if_nonpositive(quotient) if positive_only else quotient


def age_from_year(c: Column, reference_year: int = 2026) -> Column:
    return F.lit(float(reference_year)) - c


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<col>_missing`` for the columns that miss at least one value.

    Choosing the columns takes one aggregate row; the rest is a projection.
    """
    found = df.agg(*[F.max(is_missing(df, c).cast("int")).alias(c) for c in columns]).first()
    chosen = [c for c in columns if found[c] == 1]
    return df.withColumns({f"{c}_missing": is_missing(df, c).cast("int") for c in chosen}) if chosen else df


def code_map(c: Column, codes: dict[str, int], strict: bool = True) -> Column:
    """Integer code of an enumerated label; an unknown label is an error."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    code = F.try_element_at(table, c)
    if not strict:
        return code
    failure = F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(c, F.lit("NULL")))).cast("int")
    return F.when(code.isNotNull(), code).otherwise(failure)
