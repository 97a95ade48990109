"""Manifests: inputs with their mappings, and where the entities go."""

from __future__ import annotations

import os
import posixpath
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate
from ..sources import delimited, documents, gridded, sinks, vector
from . import json5, mapping

KEYS = {"version", "inputs", "output", "onFailure", "schedule", "memoryProfile", "vars"}


class ManifestError(ValueError):
    """A manifest that can't be run."""


def environment(text: str, known: dict[str, str] | None = None) -> str:
    """${NAME} becomes the variable's value; one that isn't set is an error."""
    known = dict(os.environ) if known is None else known

    def value(m):
        if m[1] not in known:
            raise ManifestError(f"variable {m[1]} isn't set")
        return known[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, text)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        m = json5.loads(environment(f.read()))
    return check(m)


def check(m: dict) -> dict:
    for key in m:
        if key not in KEYS:
            raise ManifestError(f"unknown key {key!r}")
    if m.get("version") != "v1":
        raise ManifestError("version must be 'v1'")
    if not m.get("inputs"):
        raise ManifestError("a manifest has inputs")
    for k, i in enumerate(m["inputs"]):
        if "source" not in i or ("mapping" in i) == ("mappings" in i):
            raise ManifestError(f"inputs[{k}]: a source and one of mapping and mappings")
    return m


def _dialect(d: dict) -> delimited.Dialect:
    names = {"skipRows": "skip_rows", "headerRows": "header_rows", "decimalSeparator": "decimal_separator"}
    out = {names.get(k, k): v for k, v in d.items() if k not in ("nullValues", "terminator")}
    return delimited.Dialect(**out, null_values=tuple(d.get("nullValues", ())))


def read(spark: SparkSession, source: str, format_: str = "auto", dialect: dict | None = None) -> DataFrame:
    """Records with a position that follows the file and the row in it, as columns of text or variants."""
    if format_ == "auto":
        head = spark.read.format("binaryFile").load(source).select(F.substring("content", 1, 4096)).first()
        format_ = delimited.detect_format(bytes(head[0]) if head else b"", source)
    if format_ == "csv":
        df = delimited.read_delimited(spark, source, _dialect(dialect) if dialect else None, typed=False).where("_ok").drop("_ok")
    elif format_ in ("json", "geojson", "xml"):
        raw = getattr(documents, f"read_{format_}")(spark, source)
        schema = spark.read.json(raw.rdd.map(lambda r: r["record"])).schema  # Spark's own inference over all records
        df = raw.select(F.from_json("record", schema).alias("r")).select("r.*")
    elif format_ in ("kml", "kmz", "shapefile", "geopackage"):
        df = {"kml": vector.read_kml, "kmz": vector.read_kml, "shapefile": vector.read_shapefile, "geopackage": vector.read_geopackage}[format_](spark, source)
    elif format_ == "netcdf":
        df = gridded.read_netcdf(spark, source)
    else:
        raise ManifestError(f"format {format_!r} isn't read")
    return df.withColumn("__row", F.monotonically_increasing_id())


def run(spark: SparkSession, m: dict, folder: str = ".", mappings: dict[str, dict] | None = None) -> DataFrame:
    """All inputs' entities: type, id, entity. Inputs of one type are joined by id: an attribute belongs to the first
    input that gives it a value."""
    out, context = m.get("output", {}), None
    at = lambda p: p if re.match(r"[a-z]+://|/", p) else posixpath.join(folder, p)
    frames = []
    for k, i in enumerate(m["inputs"]):
        records = read(spark, at(i["source"]), i.get("format", "auto"), i.get("dialect")).withColumn("__input", F.lit(k))
        pairs = [(None, i["mapping"])] if "mapping" in i else [(x["collection"], x["mapping"]) for x in i["mappings"]]
        for collection, path in pairs:
            doc = (mappings or {}).get(path)
            if doc is None:
                with open(at(path), encoding="utf-8") as f:
                    doc = json5.loads(f.read())
            some = records if collection is None else records.where(F.col("collection") == collection)
            mode = "series" if out.get("temporal", {}).get("representation") == "series" else "current"
            frames.append(mapping.run(some, mapping.check(doc), ["__input", "__row"], out.get("representation", "normalized"), mode, {**m.get("vars", {}), **i.get("vars", {})}, context))
    union = reduce(lambda a, b: a.unionByName(b), frames)
    return union if len(frames) == 1 else join_entities(union)


def join_entities(entities: DataFrame) -> DataFrame:
    """Entities of one id from several mappings as one, member by member in the order of position."""
    members = F.map_entries(F.from_json("entity", "map<string,string>"))
    each = entities.select("id", "type", "pos", F.posexplode(members).alias("k", "m"))
    first = each.groupBy("id", "m.key").agg(F.min(F.struct("pos", "k", "type", F.col("m.value").alias("value"))).alias("x"))
    quoted = F.when(F.col("x.value").rlike(r'^\s*([\[{]|-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$|true$|false$)') & ~F.col("key").isin("id", "type"), F.col("x.value")).otherwise(F.to_json(F.array("x.value")).substr(F.lit(2), F.char_length(F.to_json(F.array("x.value"))) - 2))
    text = F.concat(F.lit('"'), "key", F.lit('":'), quoted)
    lists = first.groupBy("id").agg(F.min("x.type").alias("type"), F.min("x.pos").alias("pos"), F.array_sort(F.collect_list(F.struct("x.pos", "x.k", text.alias("t")))).alias("l"))
    return lists.select("id", "type", "pos", F.concat(F.lit("{"), F.array_join(F.transform("l", lambda x: x.getField("t")), ","), F.lit("}")).alias("entity"))


def deliver(entities: DataFrame, output: dict, schema: dict | None = None) -> DataFrame | None:
    """Checks entities and writes them to the output's target; returns the verdicts of those that weren't written."""
    mode = output.get("validation", {}).get("mode", "fail-when-schema")
    found = validate.check(F.col("entity"), schema) if schema else None
    judged = entities.withColumn("violations", found if found is not None else F.array().cast("array<string>"))
    verdict = validate.verdict(F.col("violations") if schema else None)
    good = judged.where(validate.written(mode, verdict))
    if output.get("target") == "context-broker":
        return sinks.to_broker(good, sinks.Broker(output["url"], output.get("operation", "upsert"), output.get("tenant")))
    sinks.write_files(good, output["directory"], output.get("framing", "array"))
    return judged.where(~validate.written(mode, verdict)).select("id", "violations")

