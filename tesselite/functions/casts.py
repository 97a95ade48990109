"""Conversions of values read from sources. What can't be read is null; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that are booleans.
TRUE, FALSE = ("true", "yes", "on", "1"), ("false", "no", "off", "0")
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _text(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"^\s+|\s+$", "")


def boolean(x: Column, numeric: bool = False) -> Column:
    if numeric:
        return x != 0
    t = F.lower(_text(x))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def float_(x: Column) -> Column:
    """Trims, strips one pair of quotes, reads a decimal comma; finite only."""
    t = F.regexp_replace(_text(x), r"^([\"'])(.*)\1$", "$2")
    t = F.regexp_replace(_text(t), ",", ".")
    number = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def integer(x: Column) -> Column:
    """A 64-bit integer, else a decimal truncated toward zero; out of range is refused."""
    t = _text(x)
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long"))
    number = float_(x)
    inside = (number > -9223372036854775808.0) & (number < 9223372036854775808.0)
    cut = F.when(inside & ~t.rlike(r"^[+-]?\d+$"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    return F.coalesce(whole, cut)


def infer(x: Column, nulls: tuple[str, ...] = (), separator: str = ".") -> Column:
    """The value of a delimited field as a variant: blank, \\N and listed tokens are null; a number with a leading
    zero stays text; integers, then finite decimals; only true and false are booleans."""
    if separator == ",":
        number = F.when(x.contains("."), F.lit(None)).otherwise(F.regexp_replace(x, "^([^,]*),", "$1."))
    else:
        number = x
    zero = number.rlike(r"^[+-]?0\d")
    integer_ = F.when(number.rlike(r"^[+-]?\d+$") & ~zero, number.try_cast("long"))
    decimal = F.when(number.rlike(_NUMBER) & ~zero, number.try_cast("double"))
    decimal = F.when(F.abs(decimal) < float("inf"), decimal)
    text = F.to_json(F.struct(x.alias("v")))
    json = F.when(integer_.isNotNull(), F.concat(F.lit('{"v":'), integer_.cast("string"), F.lit("}")))
    json = json.when(decimal.isNotNull(), F.to_json(F.struct(decimal.alias("v")))).when(x.isin("true", "false"), F.concat(F.lit('{"v":'), x, F.lit("}"))).otherwise(text)
    empty = x.isNull() | x.rlike(r"^\s*$") | x.isin("\\N", *nulls)
    return F.when(~empty, F.variant_get(F.parse_json(json), "$.v", "variant"))


def number_text(x: Column) -> Column:
    """A number as text: integers plain, decimals without an exponent up to 1e16 and with at least one digit after the
    point."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", x.cast("double")), "0+$", ""), "\\.$", ".0")
    text = x.cast("string")
    return F.when(~text.contains("E"), text).when(F.abs(x.cast("double")) < 1e16, F.when(x.cast("double") == F.floor(x.cast("double")), F.concat(x.cast("double").cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(plain)).otherwise(F.regexp_replace(F.lower(text), "\\.0e", "e"))


def tokens(x: Column) -> Column:
    """Items of white-space or comma separated text; blank ones are dropped."""
    return F.filter(F.split(x, r"[\s,]+"), lambda t: t != "")


def array(*parts: Column) -> Column:
    """Parts in order, JSON-array text spliced, blank items dropped; all as text."""
    lists = [F.when(p.rlike(r"^\s*\[") & F.from_json(p, "array<string>").isNotNull(), F.from_json(p, "array<string>")).otherwise(F.array(p)) for p in parts]
    return F.filter(F.flatten(F.array(*lists)), lambda t: t.isNotNull() & (F.trim(t) != ""))


def iri(x: Column) -> Column:
    """An absolute IRI: scheme and host lower-cased, no white space."""
    t = _text(x)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(t, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", "")
    slashes = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(F.lit("//"), host)).otherwise(F.lit(""))
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$") & ~t.rlike(r"[<>\"{}|\\^`]"), F.concat(scheme, F.lit(":"), slashes, rest))


def urn(x: Column) -> Column:
    """urn:<nid>:<nss>: the prefix and nid lower-cased, percent-encoded octets upper."""
    t = _text(x)
    nid = F.lower(F.regexp_extract(t, r"(?i)^urn:([a-z0-9][a-z0-9-]{0,30}[a-z0-9]):", 1))
    rest = F.regexp_replace(t, r"(?i)^urn:[a-z0-9][a-z0-9-]{0,30}[a-z0-9]:", "")
    pieces = F.transform(F.split(rest, "%"), lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 2147483647))))
    return F.when(t.rlike(r"(?i)^urn:[a-z0-9][a-z0-9-]{0,30}[a-z0-9]:[^\s#]+$") & ~rest.rlike(r"%(?![0-9A-Fa-f]{2})"), F.concat(F.lit("urn:"), nid, F.lit(":"), F.array_join(pieces, "%")))
