"""Text, collection and JSON functions of the template language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import number_text

upper, lower, trim_start, trim_end = F.upper, F.lower, F.ltrim, F.rtrim


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def capitalize(x: Column) -> Column:
    """The first character upper case, the rest lower."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2147483647)))


def title(x: Column) -> Column:
    return F.initcap(x)


def replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def truncate(x: Column, length: int = 255, end: str = "…") -> Column:
    return F.when(F.char_length(x) > length, F.concat(F.substring(x, 1, length), F.lit(end))).otherwise(x)


def wordcount(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\S+")).cast("long")


def escape(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def newlines_to_br(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n|\n|\r", "<br>")


def indent(x: Column, width: int = 4) -> Column:
    return F.regexp_replace(x, r"\n", "\n" + " " * width)


def pluralize(x: Column, singular: str = "", plural: str = "s") -> Column:
    return F.when(F.abs(x) == 1, F.lit(singular)).otherwise(F.lit(plural))


def split(x: Column, by: str) -> Column:
    return F.split(x, "\\Q" + by.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def join(x: Column, by: str = "") -> Column:
    return F.array_join(x.cast("array<string>"), by)


def default(x: Column, value: Column, falsy: bool = False) -> Column:
    if falsy:
        x = F.when(x.cast("string").isin("", "0", "false", "0.0"), F.lit(None)).otherwise(x)
    return F.coalesce(x, value)


def length(x: Column, is_array: bool = False) -> Column:
    return (F.size(x) if is_array else F.char_length(x)).cast("long")


def reverse(x: Column) -> Column:
    return F.reverse(x)


def nth(x: Column, n: int) -> Column:
    return F.get(x, F.lit(n))


def first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def last(x: Column) -> Column:
    return F.try_element_at(x, F.lit(-1))


def sort(x: Column) -> Column:
    return F.array_sort(x)


def unique(x: Column) -> Column:
    """Distinct items, in the order of their first occurrence."""
    return F.array_distinct(x)


def clean(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")


def json_decode(x: Column) -> Column:
    return F.try_parse_json(x)


def json_encode(x: Column) -> Column:
    return F.to_json(x)


def get(props: Column, key: str, kind: str = "string", missing: Column | None = None) -> Column:
    """A member of an object held as JSON text, or the default."""
    found = F.try_variant_get(F.try_parse_json(props), "$['" + key.replace("'", "\\'") + "']", kind)
    return found if missing is None else F.coalesce(found, missing)


def b64_encode(x: Column) -> Column:
    return F.base64(x.cast("binary"))


def b64_decode(x: Column) -> Column:
    return F.when(x.rlike("^[A-Za-z0-9+/]*={0,2}$"), F.unbase64(x).cast("string"))


def urlencode(x: Column, strict: bool = True) -> Column:
    """Percent-encoding with %20 for spaces; slashes stay unless strict."""
    out = F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return out if strict else F.replace(out, F.lit("%2F"), F.lit("/"))


def regex_replace(x: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(x, pattern, new)


def striptags(x: Column) -> Column:
    return F.regexp_replace(x, "<!--[\\s\\S]*?-->|<[^>]*>", "")


def spaceless(x: Column) -> Column:
    return F.regexp_replace(x, r">\s+<", "><")


#: Letters that decomposition doesn't reduce to ASCII, with what they become.
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "ı": "i"}
_PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĢģĪīĮįİĶķĹĺĻļĽľŃńŅņŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŹźŻżŽžȘșȚț"


def _base(c: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFD", c)[0]


def ascii_text(x: Column) -> Column:
    """Latin letters without their marks, inside the JVM; other letters stay as they are."""
    x = F.translate(x, _PLAIN, "".join(map(_base, _PLAIN)))
    for old, new in LETTERS.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_text(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def filesize_format(x: Column) -> Column:
    """Bytes with binary units and at most two decimals."""
    x = x.cast("double")
    out = F.when(x < 1024, F.concat(number_text(x.cast("long")), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        size = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x / 1024**k), "0+$", ""), "\\.$", "")
        out = out.when(x < 1024 ** (k + 1), F.concat(size, F.lit(f" {unit}")))
    return out


def range_(end: Column, start: int = 0, step: int = 1) -> Column:
    return F.when(end > start, F.sequence(F.lit(start), end - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
