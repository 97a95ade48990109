"""JSON, GeoJSON and XML documents as records."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_collection(df: DataFrame, path: str) -> DataFrame:
    """One record per item of the nested array at a dotted path. An item's own fields win, then those of the nearest
    parent; parents without the array stand under the name of the member that led to the item."""
    out = df
    for step in path.split("."):
        outer = [c for c in out.columns if c != step]
        kind = out.schema[step].dataType
        items = F.explode(step) if isinstance(kind, T.ArrayType) else F.col(step)
        exploded = out.select(*outer, items.alias("__item"))
        own = exploded.schema["__item"].dataType.names
        kept = [c for c in outer if c not in own]
        out = exploded.select(*kept, *[F.col("__item").getField(n).alias(n) for n in own])
    return out


def _split(document) -> list:
    """An array's items; of an object with exactly one array member that array's items; else the one record."""
    if isinstance(document, list):
        return document
    if not isinstance(document, dict):
        raise ValueError("a scalar isn't a record")
    arrays = [v for v in document.values() if isinstance(v, list)]
    return arrays[0] if len(arrays) == 1 else [document]


def _records(df: DataFrame, column: str, fn) -> DataFrame:
    """A record (JSON text) per element that fn finds in each document; position within it."""

    def rows(batches):
        for pdf in batches:
            found = [(p, k, json.dumps(r, ensure_ascii=False)) for p, t in zip(pdf["path"], pdf[column], strict=True) for k, r in enumerate(fn(t))]
            yield pd.DataFrame(found, columns=["path", "position", "record"])

    return df.select("path", column).mapInPandas(rows, "path string, position long, record string")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """path, position, record (JSON text) of each record."""
    return _records(read_text(spark, path), "document", lambda t: _split(json.loads(t)))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A record per feature: id, properties, geometry, bbox, and the collection's foreign members."""

    def features(text: str) -> list:
        d = json.loads(text)
        outer = {k: v for k, v in d.items() if k not in ("features", "type")} if d.get("type") == "FeatureCollection" else {}
        items = d["features"] if d.get("type") == "FeatureCollection" else [d]
        return [{k: f[k] for k in ("id", "properties", "geometry", "bbox") if k in f} | ({"featureCollection": outer} if outer else {}) for f in items]

    return _records(read_text(spark, path), "document", features)


def fold_xml(e: ElementTree.Element):
    """@attributes, #text, repeated children as arrays; empty elements are null; a leaf is its text."""
    name = lambda t: t.rpartition("}")[2]
    out: dict = {f"@{name(k)}": v for k, v in e.attrib.items()}
    for c in e:
        key, value = name(c.tag), fold_xml(c)
        if key in out:
            out[key] = [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
        else:
            out[key] = value
    text = (e.text or "").strip() + "".join((c.tail or "").strip() for c in e)
    if not out:
        return text or None
    if text:
        out["#text"] = text
    return out


def split_xml(text: str) -> list:
    """If exactly one kind of child of the root repeats, its elements; else the whole root."""
    root = ElementTree.fromstring(text)
    counts: dict[str, int] = {}
    for c in root:
        counts[c.tag] = counts.get(c.tag, 0) + 1
    repeated = [t for t, n in counts.items() if n > 1]
    if len(repeated) != 1:
        return [fold_xml(root)]
    items = [fold_xml(c) for c in root if c.tag == repeated[0]]
    return [x if isinstance(x, dict) else {"#text": x} for x in items]


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    return _records(read_text(spark, path), "document", split_xml)


def drop_nulls(record: Column) -> Column:
    """JSON text without null members at any depth."""

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if v is not None}
        return [strip(v) for v in x if v is not None] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else json.dumps(strip(json.loads(v)), ensure_ascii=False))

    return run(record)
