"""Instants: reading the notations of sources, and the text of dates and times. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import _text

#: strftime directives and Java's pattern letters.
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%z": "xx", "%:z": "xxx", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%", "%f": "SSSSSS"}


def epoch(x: Column) -> Column:
    """A number of seconds, milliseconds or nanoseconds since 1970, by its size; too small a number is no instant."""
    n = x.cast("double")
    whole = x.cast("decimal(38,9)")
    micros = F.when(F.abs(n) < 2e8, F.lit(None)).when(F.abs(n) < 1e11, (whole * 1000000).cast("long")).when(F.abs(n) < 1e14, (whole * 1000).cast("long")).otherwise((whole / 1000).cast("long"))
    return F.timestamp_micros(micros)


def datetime(x: Column) -> Column:
    """A date, RFC 3339 with a zone (also with a bracketed zone name that must agree), day.month or day/month stamps, or
    an epoch number in text. A bare year, a month, and a T without a zone are refused."""
    t = _text(x)
    zone = F.regexp_extract(t, r"\[([^\]]+)\]$", 1)
    bare = F.regexp_replace(t, r"\[[^\]]+\]$", "")
    rfc = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([Zz]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.upper(bare), ",", "."), r"(\.\d{6})\d+", "$1")))
    wall = F.try_to_timestamp(F.regexp_replace(F.substring(F.upper(bare), 1, 19), "T", " "))
    named = zone.rlike("^[A-Za-z]+(/[A-Za-z_+-]+)*$")
    rfc = F.when((zone == "") | ~named, rfc).when(F.to_utc_timestamp(wall, F.when(named, zone).otherwise("UTC")) == F.date_trunc("SECOND", rfc), rfc)
    date = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    spaced = F.regexp_replace(t, r"(\d{2})\.(\d{2})(\.(\d{2}))?(\.\d+)?( ?[+-]\d{2}:?\d{2}| ?Z)?$", "$1:$2:$4$5$6")
    spaced = F.when(t.rlike(r" \d{2}\.\d{2}"), F.regexp_replace(spaced, ":($|\\.|[ +Z-])", ":00$1")).otherwise(t)
    ymd = F.when(spaced.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?Z| ?[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(spaced, r"(\.\d{6})\d+", "$1"), r" (Z|[+-]\d{2}:?\d{2})$", "$1")))
    turned = F.regexp_replace(spaced, r"^(\d{1,2})/(\d{1,2})/(\d{4}) ", "$3-$2-$1 ")
    turned = F.regexp_replace(F.regexp_replace(turned, r"^(\d{4})-(\d)-", "$1-0$2-"), r"^(\d{4}-\d{2})-(\d) ", "$1-0$2 ")
    dmy = F.when(spaced.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}(:\d{2}(\.\d+)?)?"), F.try_to_timestamp(turned))
    number = F.when(t.rlike(r"^-?\d{9,19}(\.\d+)?$"), epoch(t.try_cast("decimal(38,9)")))
    return F.coalesce(rfc, date, ymd, dmy, number)


def date_text(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def _short(x: Column) -> Column:
    """A fraction of 0, 3 or 6 digits instead of always 6; sub-microseconds never arise."""
    return F.concat(F.regexp_replace(x, r"\.000000$|(?<=\.\d{3})000$", ""), F.lit("Z"))


def datetime_text(x: Column) -> Column:
    return _short(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def time_text(x: Column) -> Column:
    return _short(F.date_format(x, "HH:mm:ss.SSSSSS"))


def java_pattern(strftime: str) -> str:
    out, k, literal = "", 0, ""
    while k < len(strftime):
        for n in (3, 2):
            if (java := _STRFTIME.get(strftime[k : k + n])) and strftime[k] == "%":
                out += (f"'{literal}'" if literal else "") + java
                literal = ""
                k += n
                break
        else:
            if strftime[k].isalpha():
                literal += strftime[k]
            else:
                out += (f"'{literal}'" if literal else "") + strftime[k]
                literal = ""
            k += 1
    return out + (f"'{literal}'" if literal else "")


def date_format(x: Column, strftime: str = "%Y-%m-%d") -> Column:
    return F.date_format(x, java_pattern(strftime))


def subtract_seconds(x: Column, seconds: int, strftime: str | None = None) -> Column:
    moved = F.timestamp_micros(F.unix_micros(x.cast("timestamp")) - F.lit(seconds * 1_000_000))
    return datetime_text(moved) if strftime is None else date_format(moved, strftime)
