"""Query registry and the SQL fragments the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column so that summation order does not show."""
    return df.select(*[
        F.round(F.col(n), digits).alias(n) if k in ("double", "float") else F.col(n) for n, k in df.dtypes
    ])


# Unicode white space, for engines whose \s is ASCII only.
WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


LISTINGS = """listings AS (
 SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER), strftime(l_shipdate, '%Y%m%d')) AS listing_id,
  l_extendedprice AS price, l_quantity AS property_size_sqft, p_type AS property_type, p_brand AS building_name,
  CASE WHEN l_suppkey % 17 <> 0 THEN s_name END AS developer, n_name AS city, r_name AS state,
  l_returnflag AS tenure_type, l_linestatus AS land_title, o_orderpriority AS floor_range, l_linenumber AS bedroom,
  CAST(round(l_tax * 100) AS INTEGER) AS bathroom, CAST(round(l_discount * 100) AS INTEGER) AS parking_lot,
  CASE WHEN l_orderkey % 13 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS completion_year,
  CASE WHEN p_size % 7 <> 0 THEN p_size END AS number_of_floors,
  CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 997 END AS total_units,
  l_extendedprice / l_quantity AS unit_price
 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
 LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN orders ON l_orderkey = o_orderkey)"""

HASH = "CAST('0x' || substr({d}, {at}, {n}) AS BIGINT)"


def sql_hash(key: str, seed: int) -> str:
    """32-bit number of ``seed:key``, as in the fold operators."""
    return HASH.format(d=f"md5('{seed}:' || CAST({key} AS VARCHAR))", at=1, n=8)


def sql_fold(key: str, k: int, seed: int) -> str:
    return f"CAST({sql_hash(key, seed)} % {k} + 1 AS INTEGER)"


SCORED = LISTINGS + """, folded AS (
 SELECT *, CAST(CAST('0x' || substr(md5(listing_id), 1, 8) AS BIGINT) % 5 + 1 AS INTEGER) AS fold,
  CAST('0x' || substr(md5(listing_id), 9, 6) AS BIGINT) AS w FROM listings),
 scored AS (
 SELECT m.model, f.*, price AS actual,
  price * (1 + ((w * (7 + 4 * m.i)) % 41 - 19 - m.i) / CAST(100 AS DOUBLE)) AS predicted
 FROM folded f CROSS JOIN (VALUES ('model_a', 0), ('model_b', 1), ('model_c', 2), ('model_d', 3)) m(model, i))"""


def with_listings(body: str) -> str:
    return f"WITH {LISTINGS} {body}"


def with_scored(body: str) -> str:
    return f"WITH {SCORED} {body}"
