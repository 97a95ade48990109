"""Entities as linked-data JSON, in three representations. Member order is that of the entity, so text is assembled
member by member inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.casts import number_text
from ..functions.temporal import datetime_text

#: The member that holds the value, by kind of attribute.
VALUE = {"Property": "value", "Relationship": "object", "GeoProperty": "value", "LanguageProperty": "languageMap", "VocabProperty": "vocab", "ListProperty": "valueList", "ListRelationship": "objectList", "JsonProperty": "json"}
#: Names that no attribute may take.
RESERVED = frozenset(("id", "type", "scope", "@context", "value", "object", "languageMap", "vocab", "valueList", "objectList", "json", "observedAt", "unitCode", "datasetId", "instanceId", "createdAt", "modifiedAt", "deletedAt", "expiresAt", "valueType", "objectType", "previousValue", "entity", "entityList"))


@dataclass
class Attribute:
    """An attribute of an entity: its value as JSON text (null: absent) and its qualifiers."""

    name: str
    value: Column
    kind: str = "Property"
    observed_at: Column | None = None
    unit_code: Column | None = None
    dataset_id: Column | None = None
    expires_at: Column | None = None
    value_type: Column | None = None
    nested: list[Attribute] = field(default_factory=list)

    def __post_init__(self):
        if self.name in RESERVED:
            raise ValueError(f"{self.name!r} is a reserved name")


def quoted(x: Column) -> Column:
    """Text as JSON; null stays null (its object has no member to find). The operand stands in the result once, so that
    nested uses don't multiply it."""
    return F.regexp_substr(F.to_json(F.struct(x.cast("string").alias("v"))), F.lit(r'(?<=^\{"v":).*(?=\}$)'))


def number(x: Column) -> Column:
    return number_text(x)


def boolean(x: Column) -> Column:
    return x.cast("string")


def instant(x: Column) -> Column:
    return quoted(datetime_text(x))


def listed(items: Column, quote: bool = True) -> Column:
    """An array of texts as JSON; null if empty."""
    return F.when(F.size(items) > 0, F.to_json(items) if quote else F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))


def _object(members: list[tuple[str, Column]]) -> Column:
    parts = [F.concat(F.lit(f'"{n}":'), v) for n, v in members]  # null where the value is
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def _qualifiers(a: Attribute) -> list[tuple[str, Column]]:
    out = [("valueType", a.value_type is not None and quoted(a.value_type)), ("observedAt", a.observed_at is not None and instant(a.observed_at)), ("expiresAt", a.expires_at is not None and instant(a.expires_at)), ("unitCode", a.unit_code is not None and quoted(a.unit_code)), ("datasetId", a.dataset_id is not None and quoted(a.dataset_id))]
    return [(n, v) for n, v in out if isinstance(v, Column)]


def normalized_attribute(a: Attribute) -> Column:
    members = [("type", F.lit(f'"{a.kind}"')), (VALUE[a.kind], a.value), *_qualifiers(a), *[(n.name, normalized_attribute(n)) for n in a.nested]]
    return F.when(a.value.isNotNull(), _object(members))


def concise_attribute(a: Attribute) -> Column:
    """A property, geometry or vocabulary value without qualifiers is its bare value; the rest are objects without a type."""
    extra = [*_qualifiers(a), *[(n.name, concise_attribute(n)) for n in a.nested]]
    whole = _object([(VALUE[a.kind], a.value), *extra])
    if a.kind in ("Property", "GeoProperty", "ListProperty"):
        bare = F.lit(True)
        for raw in (a.value_type, a.observed_at, a.expires_at, a.unit_code, a.dataset_id, *[n.value for n in a.nested]):
            bare = bare if raw is None else bare & raw.isNull()
        if a.kind != "ListProperty":
            whole = F.when(bare & ~a.value.startswith('{"value"'), a.value).otherwise(whole)
    return F.when(a.value.isNotNull(), whole)


def simplified_attribute(a: Attribute) -> Column:
    """The value alone; a language map keeps its wrapper."""
    if a.kind == "LanguageProperty":
        return F.when(a.value.isNotNull(), _object([("languageMap", a.value)]))
    if a.kind in ("VocabProperty", "JsonProperty"):
        return F.when(a.value.isNotNull(), _object([(VALUE[a.kind], a.value)]))
    return a.value


REPRESENTATIONS = {"normalized": normalized_attribute, "concise": concise_attribute, "simplified": simplified_attribute}


def entity(representation: str, id_: Column, kind: str, attributes: list[Attribute], scopes: Column | None = None, expires_at: Column | None = None, context: str | None = None) -> Column:
    """One entity as JSON text."""
    one = REPRESENTATIONS[representation]
    members = [("@context", F.lit(context))] if context else []
    members += [("id", quoted(id_)), ("type", F.lit(f'"{kind}"'))]
    if representation != "simplified":
        if scopes is not None:
            members.append(("scope", F.when(F.size(scopes) == 1, quoted(F.get(scopes, F.lit(0)))).otherwise(listed(scopes))))
        if expires_at is not None:
            members.append(("expiresAt", instant(expires_at)))
    members += [(a.name, one(a)) for a in attributes]
    return F.when(id_.isNotNull(), _object(members))
