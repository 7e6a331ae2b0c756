"""Numeric expressions: coercion, geography, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR_KM = 20000.0


def number(c: Column) -> Column:
    """As a double; what isn't a number is null."""
    return c.cast("string").try_cast("double")


def log_positive(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0)))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def distance_km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular; a query without a latitude (or at 0) is far from everything."""
    d = F.sqrt(F.pow(lat2 - lat, F.lit(2.0)) + F.pow((lon2 - lon) * F.cos(F.radians(lat)), F.lit(2.0))) * 111.0
    return F.when(F.coalesce(lat, F.lit(0.0)) == 0.0, F.lit(FAR_KM)).otherwise(F.coalesce(d, F.lit(FAR_KM)))


def geo_blend(same: Column, prob: Column, km: Column) -> Column:
    return F.greatest(same, prob, F.exp(-km / 50.0) * 0.35)


def finite(c: Column, otherwise: float = -1e20) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(otherwise)).otherwise(c)


def logit(c: Column, eps: float = 1e-7) -> Column:
    p = F.greatest(F.least(c, F.lit(1.0 - eps)), F.lit(eps))
    return F.log(p / (F.lit(1.0) - p))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def hash_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """A bucket that every engine with MD5 computes alike."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(buckets))
