"""Identifiers of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_text

PREFIX = "urn:ngsi-ld"


def clean_id(x: Column) -> Column:
    """Only letters, digits, - and _; accented Latin letters lose their marks. Null without a letter or digit."""
    kept = F.regexp_replace(ascii_text(x.cast("string")), "[^A-Za-z0-9_-]", "")
    return F.when(kept.rlike("[A-Za-z0-9]"), kept)


def urn(kind: str, *parts: Column) -> Column:
    """urn:ngsi-ld:<kind>:<id>; null if any part is absent or empty or the id has no letter or digit."""
    whole = parts[0].cast("string") if len(parts) == 1 else F.concat(*[p.cast("string") for p in parts])
    present = F.lit(True)
    for p in parts:
        present = present & (F.coalesce(p.cast("string"), F.lit("")) != "")
    return F.when(present, F.concat(F.lit(f"{PREFIX}:{kind}:"), clean_id(whole)))


def scopes(*parts: Column) -> Column:
    """Legal scopes, distinct, by code point; null if one isn't legal (levels start with a letter and are joined by /)."""
    all_ = F.array(*parts)
    legal = F.forall(all_, lambda s: s.isNull() | s.rlike(r"^/?[A-Za-z]\w*(/[A-Za-z]\w*)*$"))
    return F.when(legal, F.array_sort(F.array_distinct(F.filter(all_, lambda s: s.isNotNull()))))
