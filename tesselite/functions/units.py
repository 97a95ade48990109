"""Unit notations and their common codes (UN/CEFACT Recommendation 20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code, symbols and names of frequent units. The full list can be passed to ``code``.
UNITS = {
    "CEL": ("°c", "℃", "celsius", "degree celsius", "degc"), "FAH": ("°f", "fahrenheit", "degree fahrenheit"), "KEL": ("k", "kelvin"),
    "MTR": ("m", "metre", "meter"), "KMT": ("km", "kilometre", "kilometer"), "CMT": ("cm", "centimetre", "centimeter"), "MMT": ("mm", "millimetre", "millimeter"), "4H": ("um", "micrometre", "micrometer"),
    "MTS": ("m/s", "metre per second", "meter per second"), "KMH": ("km/h", "kilometre per hour", "kilometer per hour"), "MTK": ("m2", "square metre", "square meter"), "KMK": ("km2", "square kilometre"), "HAR": ("ha", "hectare"),
    "MTQ": ("m3", "cubic metre", "cubic meter"), "LTR": ("l", "litre", "liter"), "MQH": ("m3/h", "cubic metre per hour"), "KGM": ("kg", "kilogram"), "GRM": ("g", "gram"), "TNE": ("t", "tonne"),
    "GQ": ("ug/m3", "microgram per cubic metre"), "GP": ("mg/m3", "milligram per cubic metre"), "PAL": ("pa", "pascal"), "A97": ("hpa", "hectopascal"), "KPA": ("kpa", "kilopascal"), "BAR": ("bar",), "MBR": ("mbar", "millibar"),
    "P1": ("%", "percent"), "DD": ("°", "deg", "degree"), "C81": ("rad", "radian"), "SEC": ("s", "second"), "MIN": ("min", "minute"), "HUR": ("h", "hour"), "DAY": ("d", "day"), "HTZ": ("hz", "hertz"),
    "VLT": ("v", "volt"), "AMP": ("a", "ampere"), "WTT": ("w", "watt"), "KWT": ("kw", "kilowatt"), "KWH": ("kwh", "kilowatt hour"), "WHR": ("wh", "watt hour"), "JOU": ("j", "joule"), "OHM": ("ohm", "ω"),
    "LUX": ("lx", "lux"), "2N": ("db", "decibel"), "59": ("ppm", "part per million"), "61": ("ppb", "part per billion"), "D54": ("w/m2", "watt per square metre"), "C62": ("1", "one"), "D10": ("s/m", "siemens per metre"),
}


#: Symbols whose upper case is another unit than their lower case.
CASED = {"S": "SIE", "H": "81", "T": "D33"}


def fold(x: Column) -> Column:
    """Notations that mean the same, alike: micro signs, raised digits, dots and spaces."""
    x = F.translate(F.lower(F.trim(x)), "µμ²³·⋅", "uu23..")
    return F.regexp_replace(F.regexp_replace(x, r"\^", ""), r"\s+", " ")


def code(x: Column, units: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The code of a unit's code, symbol or name; null if there is none or more than one. Case counts only for symbols that
    mean different units by it."""
    owners: dict[str, set[str]] = {}
    for c, names in (units or UNITS).items():
        for n in (c.lower(), *names):
            owners.setdefault(n, set()).add(c)
    for c in units or UNITS:  # a code that stands by itself is that code
        owners[c.lower()] = {c}
    known = F.create_map(*[F.lit(y) for n, cs in sorted(owners.items()) if len(cs) == 1 for y in (n, *cs)])
    cased = F.create_map(*[F.lit(v) for pair in CASED.items() for v in pair])
    return F.coalesce(F.try_element_at(cased, F.trim(x)), F.try_element_at(known, fold(x)))
