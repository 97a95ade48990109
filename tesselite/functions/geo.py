"""Geospatial functions as columns. Geometries are GeoJSON text; what fails is null."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Made once: json.dumps makes an encoder at each call that names separators.
_text = json.JSONEncoder(separators=(",", ":")).encode
#: What makes a geometry null.
FAILURES = (G.GeometryError, ValueError, TypeError, KeyError, IndexError)


def geohash(lat: Column, lon: Column, precision: int = 9) -> Column:
    """Inside the JVM: both coordinates as cell numbers, their bits interleaved, five to a character."""
    bits = precision * 5
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cells = lambda x, low, width, n: F.least(F.floor((x.cast("double") - low) / width * float(1 << n)), F.lit((1 << n) - 1)).cast("long")
    x, y = cells(lon, -180.0, 360.0, lon_bits), cells(lat, -90.0, 180.0, lat_bits)
    chars = []
    for c in range(precision):
        number = F.lit(0).cast("long")
        for b in range(5):
            k = c * 5 + b
            source, n = (x, lon_bits - 1 - k // 2) if k % 2 == 0 else (y, lat_bits - 1 - k // 2)
            number = number + F.shiftright(source, n).bitwiseAND(F.lit(1).cast("long")) * (1 << (4 - b))
        chars.append(F.substring(F.lit(BASE32), (number + 1).cast("int"), F.lit(1)))
    inside = lat.cast("double").between(-90.0, 90.0) & lon.cast("double").between(-180.0, 180.0)
    return F.when(inside, F.concat(*chars))


def in_range(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0), F.lit(False))


def _half(x: Column, hemispheres: str) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    n = lambda k: F.coalesce(F.get(found, F.lit(k)).try_cast("double"), F.lit(0.0))
    size = n(0) + n(1) / 60 + n(2) / 3600
    negative = x.rlike(f"(?i)[{hemispheres}]") | x.rlike(r"^\s*-")
    return F.when(F.size(found) > 0, F.when(negative, -size).otherwise(size))


def dms_point(x: Column) -> Column:
    """Degrees, minutes and seconds (latitude, then longitude, with hemispheres) as a Point's JSON text."""
    lat = F.regexp_extract(x, r"(?i)^(.*?[NS])[\s,;]*(.*?[EWO])\s*$", 1)
    lon = F.regexp_extract(x, r"(?i)^(.*?[NS])[\s,;]*(.*?[EWO])\s*$", 2)
    a, b = _half(lat, "S"), _half(lon, "W")
    return F.when((lat != "") & in_range(b, a), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(b, a).alias("coordinates"))))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all cores before kernels run on them, as one task else takes what one row group of a file holds.
    Best put after the columns have been chosen and before geometries are written."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def _json(fn):
    """Applies fn to each geometry; failures are null."""

    def one(x):
        try:
            return fn(G.load(x)) if x is not None else None
        except FAILURES:
            return None

    return one


def _number(name: str, x: Column) -> Column:
    kernel = getattr(G, name)

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([_json(kernel)(v) for v in values], dtype="float64")

    return run(x)


def area(x: Column) -> Column:
    return _number("area", x)


def length(x: Column) -> Column:
    return _number("length", x)


def apply(name: str, x: Column) -> Column:
    """A kernel that gives a geometry, as JSON text."""
    kernel = getattr(G, name)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        found = [_json(kernel)(v) for v in values]
        return pd.Series([None if g is None else _text(g) for g in found], dtype="object")

    return run(x)


def bbox(x: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([_json(G.bbox)(v) for v in values], dtype="object")

    return run(x)


def _converted(v, to: str | None, using: str | None, settled: dict | None = None) -> str | None:
    try:
        return None if v is None else _text(G.turned(G.settled(v, to) if settled is None else settled, to, using))
    except FAILURES:
        return None


def convert(x: Column, to: str | None = None, using: str | None = None) -> Column:
    if using is not None and using not in G.STRATEGIES:
        raise ValueError(f"unknown strategy {using!r}")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([_converted(v, to, using) for v in values], dtype="object")

    return run(x)


def conversions(x: Column, ways: dict[str, tuple[str | None, str | None]]) -> Column:
    """Several conversions of each geometry, which is read and checked once for all: a struct of texts by name."""
    for _, using in ways.values():
        if using is not None and using not in G.STRATEGIES:
            raise ValueError(f"unknown strategy {using!r}")

    def each(v):
        try:
            # Raw coordinates have no type before one is asked for.
            g = None if v is None or v.lstrip().startswith("[") else G.settled(v)
        except FAILURES:
            v = g = None
        return [_converted(v, to, using, g) for to, using in ways.values()]

    @F.pandas_udf(", ".join(f"`{n}` string" for n in ways))
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([each(v) for v in values], columns=list(ways), dtype="object")

    return run(x)


def point(lon: Column, lat: Column) -> Column:
    return F.when(in_range(lon, lat), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon.cast("double"), lat.cast("double")).alias("coordinates"))))
