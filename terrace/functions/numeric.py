"""Numeric column functions: transforms, distances, target forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2.0
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def bias_corrected_skew(c: str) -> Column:
    """Sample skewness from Spark's population skewness; NULL below three rows."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def to_target(strategy: str, price: Column, size: Column, lam: float | None = None) -> Column:
    """Model target from a price: unit, direct, log_unit, log_price or boxcox."""
    price = price.cast("double")
    if strategy == "unit":
        return F.try_divide(price, size.cast("double"))
    if strategy == "direct":
        return price
    if strategy == "log_unit":
        return F.log1p(F.try_divide(price, size.cast("double")))
    if strategy == "log_price":
        return F.log1p(price)
    if strategy == "boxcox":
        if lam is None:
            raise ValueError("boxcox needs the lambda of the training rows")
        return F.log(price) if lam == 0 else (F.pow(price, F.lit(lam)) - 1.0) / lam
    raise ValueError(f"unknown target strategy: {strategy}")


def from_target(strategy: str, value: Column, size: Column, lam: float | None = None) -> Column:
    """Invert :func:`to_target` into a non-negative total price."""
    size = size.cast("double")
    if strategy == "unit":
        price = value * size
    elif strategy == "direct":
        price = value
    elif strategy == "log_unit":
        price = F.expm1(value) * size
    elif strategy == "log_price":
        price = F.expm1(value)
    elif strategy == "boxcox":
        if lam is None:
            raise ValueError("boxcox needs the lambda of the training rows")
        price = F.exp(value) if lam == 0 else F.pow(F.greatest(value * lam + 1.0, F.lit(0.0)), F.lit(1.0 / lam))
    else:
        raise ValueError(f"unknown target strategy: {strategy}")
    return F.greatest(price, F.lit(0.0))
