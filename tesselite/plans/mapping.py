"""Mapping documents as plans.

A mapping is read once on the driver and becomes columns: per record an id, scopes, an expiry, and each attribute as
JSON text with its qualifiers. Records of one entity are then resolved by one grouped aggregation, and entities are
written out in a representation. Load-time checks refuse what could never work.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, geo, identity, temporal, units
from ..functions.geometry import STRATEGIES
from ..operators import represent as R
from .template import Compiler, TemplateError, _Loop, parse, reads

KEYS = {"version", "dataModel", "identity", "scope", "expiresAt", "attributes"}
#: What each kind of attribute may be converted by.
GEOMETRIES = ("geometry", "point", "multipoint", "linestring", "multilinestring", "polygon", "multipolygon")
CONVERSIONS = ("boolean", "bool", "integer", "int", "float", "string", "iri", "urn", "array", "object", "json", "datetime", "date", "time", *GEOMETRIES)
ALLOWED = {"Property": CONVERSIONS, "GeoProperty": GEOMETRIES, "ListProperty": CONVERSIONS, "JsonProperty": ("array", "object", "json"), "LanguageProperty": ("object",), "VocabProperty": ("iri", "urn"), "Relationship": (), "ListRelationship": ()}
QUALIFIERS = ("observedAt", "expiresAt", "unitCode", "datasetId")
DEEPEST = 50
#: The columns of a token's row: the token, and its place in the list.
TOKEN, PLACE = "__token", "__place"


class MappingError(ValueError):
    """A mapping that can't be loaded."""


def check(m: dict, where: str = "mapping") -> dict:
    for key in m:
        if key not in KEYS:
            raise MappingError(f"{where}: unknown key {key!r}")
    if where == "mapping" and m.get("version") != "v4":
        raise MappingError(f"{where}: version must be 'v4'")
    if set(m.get("identity", {})) != {"entityName"}:
        raise MappingError(f"{where}: identity holds entityName alone")
    if not re.fullmatch(r"[A-Za-z][\w.]*(/[A-Za-z]\w*)?", m.get("dataModel", "")):
        raise MappingError(f"{where}: dataModel {m.get('dataModel')!r} can't form an id")
    for name, a in m.get("attributes", {}).items():
        at = f"{where}.{name}"
        if name in R.RESERVED or not re.fullmatch(r"[^\W\d_]\w*", name):
            raise MappingError(f"{at}: reserved or malformed name")
        kind = a.get("type", "Property")
        if kind not in ALLOWED:
            raise MappingError(f"{at}: unknown type {kind!r}")
        how = a.get("transformation")
        if how is not None and how not in ALLOWED[kind]:
            raise MappingError(f"{at}: {kind} can't be {how!r}")
        using = a.get("geometry", {}).get("convert")
        if using is not None and using != "flatten" and using not in STRATEGIES:
            raise MappingError(f"{at}: unknown conversion {using!r}")
        if kind in ("Relationship", "ListRelationship") and "syntheticEntity" not in a and not a.get("target", {}).get("entity"):
            raise MappingError(f"{at}: target.entity is missing")
        if kind == "ListRelationship" and "source" not in a:
            raise MappingError(f"{at}: source is missing")
        if "syntheticEntity" in a:
            check(a["syntheticEntity"], f"{at}.syntheticEntity")
        for source in _sources(a):
            try:
                parse(source)
            except TemplateError as e:
                raise MappingError(f"{at}: {e}") from None
    return m


def _sources(a: dict) -> list[str]:
    own = a.get("source")
    out = [own] if isinstance(own, str) else list(own or [])
    for part in ("languageMap", "mappings", "properties"):
        for sub in a.get(part, {}).values():
            out += _sources(sub)
    for sub in a.get("instances", []):
        out += _sources(sub)
    return out


def columns_read(m: dict) -> set[str]:
    """What a mapping reads of its records, for pruning; {'*'} if it can't be told."""
    sources = [m["identity"]["entityName"], *([m["scope"]] if isinstance(m.get("scope"), str) else m.get("scope", [])), *([m["expiresAt"]] if "expiresAt" in m else [])]
    for a in m.get("attributes", {}).values():
        sources += _sources(a)
        if "syntheticEntity" in a:
            sources += [f"{{{{ {c} }}}}" for c in columns_read(a["syntheticEntity"]) if c != "*"]
    return set().union(*[reads(s) for s in sources])


@dataclass
class Entities:
    """Entities of one mapping: id, pos, scopes, expiresAt and a struct per attribute."""

    kind: str
    df: DataFrame
    attributes: dict[str, dict] = field(default_factory=dict)
    temporal: bool = False


def _json_value(c: Compiler, x: Column) -> Column:
    """Any value as JSON text."""
    kind = c.kind(x)
    if isinstance(kind, T.StringType):
        return R.quoted(x)
    if isinstance(kind, T.NumericType):
        return R.number(x)
    if isinstance(kind, T.BooleanType):
        return R.boolean(x)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return R.instant(x.cast("timestamp"))
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    return F.to_json(x)


def convert(c: Compiler, x: Column, how: str | None, using: str | None = None) -> Column:
    """A value under a transformation, as JSON text; null if it can't be read."""
    if how is None:
        return _json_value(c, x)
    t = c.as_text(x)
    if how in ("boolean", "bool"):
        return R.boolean(casts.boolean(x if isinstance(c.kind(x), T.NumericType) else t, isinstance(c.kind(x), T.NumericType)))
    if how in ("integer", "int"):
        return R.number(casts.integer(t))
    if how == "float":
        return R.number(casts.float_(t))
    if how == "string":
        return R.quoted(t)
    if how in ("iri", "urn"):
        return R.quoted(getattr(casts, how)(t))
    if how == "array":
        return R.listed(x.cast("array<string>") if isinstance(c.kind(x), T.ArrayType) else casts.array(t))
    if how == "object":
        return F.when(F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*\{"), t)
    if how == "json":
        return F.when(F.try_parse_json(t).isNotNull(), t)
    if how in ("datetime", "date", "time"):
        at = x.cast("timestamp") if isinstance(c.kind(x), T.TimestampType | T.TimestampNTZType) else temporal.epoch(x) if isinstance(c.kind(x), T.NumericType) else temporal.datetime(t)
        return R.quoted({"datetime": temporal.datetime_text, "date": temporal.date_text, "time": temporal.time_text}[how](at))
    return geo.convert(t, None if how == "geometry" else how, None if using == "flatten" else using)


def _instant(c: Compiler, source: str) -> Column:
    x = c.compile(source)
    kind = c.kind(x)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return x.cast("timestamp")
    return temporal.epoch(x) if isinstance(kind, T.NumericType) else temporal.datetime(c.as_text(x))


def _parts(c: Compiler, source) -> list[Column]:
    return [c.compile(s) for s in ([source] if isinstance(source, str) else source)]


def _joined(c: Compiler, parts: list[Column]) -> Column:
    """Parts of an identifier or text: absent if one of them is."""
    texts = [F.when(c.as_text(p) != "", c.as_text(p)) for p in parts]
    return texts[0] if len(texts) == 1 else F.concat(*texts)


def _several(c: Compiler, sources: list[str], how: str | None) -> Column:
    """Several parts under one transformation, as JSON text. Numbers and booleans are read from the first part there is;
    arrays take all items; geometries keep the parts' structure; without a transformation the parts stay as they were
    read; all else reads the parts there are as one text. Nothing comes of parts whose fields are all absent."""
    parts = _parts(c, sources)
    texts = [c.as_text(p) for p in parts]
    fields = [t for s, t in zip(sources, texts, strict=True) if reads(s)]
    there = F.coalesce(*[F.when(F.trim(t) != "", F.lit(True)) for t in fields]).isNotNull() if fields else F.lit(True)
    if how in ("boolean", "bool", "integer", "int", "float"):
        out = F.coalesce(*[F.when(p.isNotNull(), F.struct(convert(c, p, how).alias("v"))) for p in parts]).getField("v")
    elif how == "array":
        out = R.listed(casts.array(*[F.to_json(p) if isinstance(c.kind(p), T.ArrayType) else t for p, t in zip(parts, texts, strict=True)]))
    elif how is None or how in GEOMETRIES:
        kept = lambda t: F.when(t.rlike(r"^\s*([\[{]|[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$)"), F.trim(t)).otherwise(R.quoted(t))
        items = F.filter(F.array(*[_json_value(c, p) if how is None else kept(t) for p, t in zip(parts, texts, strict=True)]), lambda x: x.isNotNull())
        whole = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
        out = F.when(F.size(items) == 1, F.get(items, F.lit(0))).when(F.size(items) > 1, whole) if how is None else geo.convert(whole, None if how == "geometry" else how)
    else:
        out = convert(c, F.nullif(F.concat_ws("", *texts), F.lit("")), how)
    return F.when(there, out)


def _tokens(c: Compiler, source) -> Column:
    """The tokens that a list's source names, in order."""
    lists = [p.cast("array<string>") if isinstance(c.kind(p), T.ArrayType) else casts.tokens(c.as_text(p)) for p in _parts(c, source)]
    return F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))


def _per_token(x):
    """A synthetic mapping that is written once per token, which it reads as ``this[0]``."""
    if isinstance(x, dict):
        return {k: _per_token(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_per_token(v) for v in x]
    return re.sub(r"\bthis\s*\[\s*0\s*\]", TOKEN, x) if isinstance(x, str) else x


def _targets(c: Compiler, a: dict) -> Column:
    """Ids of a list's targets, in order, distinct; those of synthetic entities by the identity of each token's."""
    if "syntheticEntity" in a:
        e, typed = _per_token(a["syntheticEntity"]), Compiler(c.df.withColumn(TOKEN, F.lit("")), c.vars)

        def minted(x: Column) -> Column:
            loop = _Loop(typed, TOKEN, x)
            return identity.urn(model_name(e), _joined(loop, _parts(loop, e["identity"]["entityName"])))

    else:

        def minted(x: Column) -> Column:
            return identity.urn(a["target"]["entity"], x)

    return F.array_distinct(F.filter(F.transform(_tokens(c, a["source"]), minted), lambda x: x.isNotNull()))


def value(c: Compiler, a: dict, depth: int = 0) -> Column:
    """An attribute's value as JSON text."""
    if depth > DEEPEST:
        raise MappingError("mappings are nested too deeply")
    kind = a.get("type", "Property")
    if "mappings" in a:
        members = [(n, value(c, s, depth + 1)) for n, s in a["mappings"].items()]
        some = F.coalesce(*[v for _, v in members]).isNotNull()
        return F.when(some, R._object(members))
    if "languageMap" in a:
        members = [(n, R.quoted(_joined(c, _parts(c, s["source"])))) for n, s in a["languageMap"].items()]
        return F.when(F.coalesce(*[v for _, v in members]).isNotNull(), R._object(members))
    if kind == "Relationship":
        if "syntheticEntity" in a:
            e = a["syntheticEntity"]
            return R.quoted(identity.urn(model_name(e), _joined(c, _parts(c, e["identity"]["entityName"]))))
        return R.quoted(identity.urn(a["target"]["entity"], _joined(c, _parts(c, a["source"]))))
    if kind == "ListRelationship":
        return R.listed(_targets(c, a))
    how = a.get("transformation") or {"GeoProperty": "geometry", "VocabProperty": "iri", "JsonProperty": "json"}.get(kind)
    parts = _parts(c, a["source"])
    if kind == "ListProperty":
        lists = [p.cast("array<string>") if isinstance(c.kind(p), T.ArrayType) else casts.tokens(c.as_text(p)) for p in parts]
        items = F.flatten(F.array(*lists))
        if how in (None, "array", "string"):
            return R.listed(items)
        one = {"integer": casts.integer, "int": casts.integer, "float": casts.float_, "boolean": casts.boolean, "bool": casts.boolean}[how]
        read = F.transform(items, lambda x: one(x))
        # One item that can't be read costs the list.
        return F.when((F.size(items) > 0) & F.forall(read, lambda x: x.isNotNull()), F.to_json(read))
    if len(parts) > 1:
        return _several(c, a["source"], how)
    return convert(c, parts[0], how, a.get("geometry", {}).get("convert"))


def model_name(m: dict) -> str:
    return m["dataModel"].rpartition("/")[2]


def fragments(df: DataFrame, m: dict, pos, vars: dict | None = None) -> Entities:
    """One row per record that names an entity: id, pos, scopes, expiresAt, a struct{value, observedAt, ...} per attribute."""
    check(m) if "version" in m else None
    c, kind = Compiler(df, vars or {}), model_name(m)
    out = [identity.urn(kind, _joined(c, _parts(c, m["identity"]["entityName"]))).alias("id"), F.struct(*[F.col(p) for p in ([pos] if isinstance(pos, str) else pos)]).alias("pos")]
    scopes = m.get("scope")
    legal = F.lit(True)
    if scopes is not None:
        parts = _parts(c, scopes)
        lists = [p.cast("array<string>") if isinstance(c.kind(p), T.ArrayType) else F.array(c.as_text(p)) for p in parts]
        all_ = F.filter(F.flatten(F.array(*lists)), lambda s: s.isNotNull())
        legal = F.forall(all_, lambda s: s.rlike(r"^/?[A-Za-z]\w*(/[A-Za-z]\w*)*$"))
        out.append(F.array_sort(F.array_distinct(all_)).alias("scopes"))
    if "expiresAt" in m:
        out.append(_instant(c, m["expiresAt"]).alias("expiresAt"))
    made: dict[str, dict] = {}
    for name, a in m.get("attributes", {}).items():
        for k, one in enumerate(a.get("instances") or [a]):
            one = {**a, **one, "properties": {**a.get("properties", {}), **one.get("properties", {})}} if one is not a else a
            q = one.get("properties", {})
            members = [value(c, one).alias("value")]
            for n in QUALIFIERS:
                if n in q:
                    x = _instant(c, q[n]["source"]) if n.endswith("At") else units.code(_joined(c, _parts(c, q[n]["source"]))) if n == "unitCode" else casts.iri(_joined(c, _parts(c, q[n]["source"])))
                    members.append(x.alias(n))
            nested = {n: s for n, s in q.items() if n not in QUALIFIERS}
            members += [value(c, s).alias(f"sub_{n}") for n, s in nested.items()]
            key = name if not a.get("instances") else f"{name}#{k}"
            out.append(F.struct(*members).alias(key))
            made[key] = {"name": name, "kind": a.get("type", "Property"), "qualifiers": [n for n in QUALIFIERS if n in q], "nested": {n: s.get("type", "Property") for n, s in nested.items()}, "slot": str(q.get("observedAt", {}).get("source", ""))}
    rows = df.where(legal).select(*out).where("id is not null")
    return Entities(kind, rows, made, any(a["slot"] for a in made.values()))


def resolve(f: Entities, mode: str = "current", sparse: bool = False) -> Entities:
    """Records of one id become one entity in a single aggregation. Static mappings keep what is held first; temporal
    ones the latest record per observedAt template, and for the rest the newest record; ``series`` keeps all."""
    groups = []
    slots = {a["slot"] for a in f.attributes.values() if a["slot"]}
    at_of = {s: next(k for k, a in f.attributes.items() if a["slot"] == s) for s in slots}
    rank = lambda s: F.struct(F.col(f"`{at_of[s]}`.observedAt").alias("at"), F.col("pos"))
    for key, a in f.attributes.items():
        col = F.col(f"`{key}`")
        if not f.temporal:
            groups.append(F.min_by(F.struct(col), F.when(col.getField("value").isNotNull(), F.col("pos")) if sparse else F.col("pos")).getField(key).alias(key))
        elif mode == "series" and a["slot"]:
            item = F.struct(col.getField("observedAt").alias("at"), "pos", col.alias("x"))
            groups.append(F.transform(F.array_sort(F.collect_list(F.when(col.getField("value").isNotNull(), item))), lambda i: i.getField("x")).alias(key))
        elif mode == "series":
            groups.append(F.min_by(F.struct(col), F.when(col.getField("value").isNotNull(), F.col("pos"))).getField(key).alias(key))
        elif a["slot"]:
            groups.append(F.max_by(F.struct(col), rank(a["slot"])).getField(key).alias(key))
        else:
            newest = F.struct(F.greatest(*[F.col(f"`{at_of[s]}`.observedAt") for s in sorted(slots)]) if len(slots) > 1 else F.col(f"`{at_of[next(iter(slots))]}`.observedAt"), F.col("pos"))
            groups.append(F.max_by(F.struct(col), newest).getField(key).alias(key))
    if "scopes" in f.df.columns:
        groups.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("scopes")))).alias("scopes"))
    if "expiresAt" in f.df.columns:
        if not f.temporal:
            groups.append(F.max_by("expiresAt", F.when(F.col("expiresAt").isNotNull(), F.col("pos"))).alias("expiresAt"))
        elif mode == "series":
            groups.append(F.max("expiresAt").alias("expiresAt"))
        else:
            groups.append(F.max_by("expiresAt", rank(sorted(slots)[0])).alias("expiresAt"))
    df = f.df.groupBy("id").agg(F.min("pos").alias("pos"), *groups)
    return Entities(f.kind, df, f.attributes, f.temporal)


def to_json(e: Entities, representation: str = "normalized", context: str | None = None) -> DataFrame:
    """id, type, pos and entity (JSON text) of each."""
    attributes = []
    by_name: dict[str, list[str]] = {}
    for key, a in e.attributes.items():
        by_name.setdefault(a["name"], []).append(key)
    extra = {}
    for name, keys in by_name.items():
        a = e.attributes[keys[0]]

        def one(col: Column, a=a, name=name) -> R.Attribute:
            q = {{"observedAt": "observed_at", "expiresAt": "expires_at", "unitCode": "unit_code", "datasetId": "dataset_id"}[n]: col.getField(n) for n in a["qualifiers"]}
            nested = [R.Attribute(n, col.getField(f"sub_{n}"), k) for n, k in a["nested"].items()]
            return R.Attribute(name, col.getField("value"), a["kind"], nested=nested, **q)

        first = F.col(f"`{keys[0]}`")
        if isinstance(e.df.schema[keys[0]].dataType, T.ArrayType):
            make = R.REPRESENTATIONS[representation]
            items = F.transform(first, _lambda(lambda x, one=one, make=make: make(one(x))))
            extra[name] = F.when(F.size(items) == 1, F.get(items, F.lit(0))).when(F.size(items) > 1, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
            attributes.append(R.Attribute(name, extra[name], a["kind"]))
        elif len(keys) > 1:
            make = R.REPRESENTATIONS[representation]
            items = F.filter(F.array(*[make(one(F.col(f"`{k}`"), e.attributes[k])) for k in keys]), lambda x: x.isNotNull())
            extra[name] = F.when(F.size(items) == 1, F.get(items, F.lit(0))).when(F.size(items) > 1, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
            attributes.append(R.Attribute(name, extra[name], a["kind"]))
        else:
            attributes.append(one(first))
    make = R.REPRESENTATIONS[representation]
    members = [("@context", F.lit(context))] if context else []
    members += [("id", R.quoted(F.col("id"))), ("type", F.lit(f'"{e.kind}"'))]
    if representation != "simplified":
        if "scopes" in e.df.columns:
            members.append(("scope", F.when(F.size("scopes") == 1, R.quoted(F.get("scopes", F.lit(0)))).otherwise(R.listed(F.col("scopes")))))
        if "expiresAt" in e.df.columns:
            members.append(("expiresAt", R.instant(F.col("expiresAt"))))
    members += [(a.name, extra.get(a.name) if a.name in extra else make(a)) for a in attributes]
    return e.df.select("id", F.lit(e.kind).alias("type"), "pos", R._object(members).alias("entity"))


def _lambda(fn):
    return lambda x: fn(x)


def synthetics(df: DataFrame, m: dict, pos, vars: dict | None = None) -> list[Entities]:
    """Entities that a record describes beside its own."""
    out = []
    keys = [pos] if isinstance(pos, str) else list(pos)
    for a in m.get("attributes", {}).values():
        if "syntheticEntity" in a and a.get("type") == "ListRelationship":
            rows = df.select("*", F.posexplode(_tokens(Compiler(df, vars or {}), a["source"])).alias(PLACE, TOKEN))
            out.append(fragments(rows, _per_token(a["syntheticEntity"]), [*keys, PLACE], vars))
        elif "syntheticEntity" in a:
            out.append(fragments(df, a["syntheticEntity"], pos, vars))
            out += synthetics(df, a["syntheticEntity"], pos, vars)
    return out


def _geometric(m) -> bool:
    """Whether some value goes through the geometry kernels."""
    if isinstance(m, dict):
        return m.get("type") == "GeoProperty" or m.get("transformation") in GEOMETRIES or any(map(_geometric, m.values()))
    return any(map(_geometric, m)) if isinstance(m, list) else isinstance(m, str) and "geo_" in m


def run(df: DataFrame, m: dict, pos, representation: str = "normalized", mode: str = "current", vars: dict | None = None, context: str | None = None) -> DataFrame:
    """Records to entities, synthetic ones included."""
    needed = columns_read(m)
    keys = [pos] if isinstance(pos, str) else list(pos)
    if "*" not in needed:
        df = df.select(*[c for c in df.columns if c in needed or c in keys])
    if _geometric(m):
        df = geo.spread(df)
    frames = [to_json(resolve(f, mode), representation, context) for f in [fragments(df, m, pos, vars), *synthetics(df, m, pos, vars)]]
    plain = F.struct(*[F.col("pos").getField(k).alias(k) for k in keys])  # a token's place counts within its record only
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("pos", plain) for f in frames])
