"""Math of the template language. A result that isn't finite is absent (null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 6.283185307179586


def finite(x: Column) -> Column:
    """x as a double, null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def _of(fn):
    return lambda x: finite(fn(x.cast("double")))


sqrt, cbrt, exp, sin, cos, tan, asin, acos, atan, radians, degrees = map(_of, (F.sqrt, F.cbrt, F.exp, F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.radians, F.degrees))


def _log(fn):
    return lambda x: finite(F.when(x.cast("double") > 0, fn(x.cast("double"))))


ln, log10, log2 = map(_log, (F.ln, F.log10, F.log2))


def sign(x: Column) -> Column:
    """-1, 0 or 1; zero of either sign is 0."""
    x = x.cast("double")
    return F.when(x > 0, 1.0).when(x < 0, -1.0).when(x == 0, 0.0)


def floor(x: Column) -> Column:
    return F.floor(x.cast("double"))


def ceil(x: Column) -> Column:
    return F.ceil(x.cast("double"))


def trunc(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def round_(x: Column, digits: int = 0) -> Column:
    return F.round(x.cast("double"), digits)


def hypot(x: Column, y: Column) -> Column:
    return finite(F.hypot(x.cast("double"), y.cast("double")))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(value, low), high))


def map_range(value: Column, from_low: Column, from_high: Column, to_low: Column, to_high: Column) -> Column:
    """Linear rescaling; an empty source range has no result."""
    share = F.try_divide(value.cast("double") - from_low.cast("double"), from_high.cast("double") - from_low.cast("double"))
    return finite(to_low.cast("double") + share * (to_high.cast("double") - to_low.cast("double")))


def atan2(y: Column, x: Column) -> Column:
    return finite(F.atan2(y.cast("double"), x.cast("double")))


def bearing(east: Column, north: Column, convention: str = "to") -> Column:
    """Compass degrees in [0, 360) of a vector; ``from`` is the direction that it comes from. Calm has none."""
    turn = {"to": 0.0, "from": 180.0}[convention]
    angle = F.pmod(F.degrees(F.atan2(east.cast("double"), north.cast("double"))) + F.lit(turn), F.lit(360.0))
    return finite(F.when((east != 0) | (north != 0), angle))


def wind_speed(u: Column, v: Column) -> Column:
    return hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    return bearing(u, v, "from")


def divide(x: Column, y: Column) -> Column:
    return finite(F.try_divide(x.cast("double"), y.cast("double")))
