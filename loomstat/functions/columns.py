"""Column expressions used by many operators. All are Spark built-ins in the end, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b; `otherwise` where b is null or not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    deg = F.degrees(F.atan2(y, x)) + 360
    return deg - 360 * F.floor(deg / 360)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, by Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def cases(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The first value whose condition holds."""
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    o = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return o if out is None else out.otherwise(o)


def escape(term: str) -> str:
    """A term as a literal part of a Java regex."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def any_word(terms: list[str], whole: bool = True) -> str:
    """A regex for any of the terms, case-insensitive."""
    body = "|".join(escape(t) for t in terms)
    return rf"(?i)\b({body})\b" if whole else rf"(?i)({body})"


def hours_before(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 3.6e9


def reasons(pairs: list[tuple[Column, str]]) -> Column:
    """The names of the conditions that hold (null counts as not), in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))
