"""Snapshots of sensor servers (JSON Lines with a header), and the requests that read such servers."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A variant per line and its kind: header, datastream, multiDatastream, thing, observation, historicalLocation."""
    v = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"))
    kinds = ("observation", "historicalLocation", "datastream", "multiDatastream", "thing")
    kind = F.when(F.try_variant_get("v", "$.sensorthingsSnapshot", "int").isNotNull(), "header")
    for k in kinds:  # an observation line also names its stream, so what is an object decides
        kind = kind.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).startswith("OBJECT"), k)
    return v.select("v", kind.alias("kind"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def instant(phenomenon_time: Column) -> Column:
    """An instant, or the end of an interval."""
    return temporal.datetime(F.element_at(F.split(phenomenon_time, "/"), -1))


def streams(lines: DataFrame) -> DataFrame:
    """A row per stream and position in its results: kind, stream, position, thing, names, unit."""
    one = lines.where("kind = 'datastream'").select(F.lit("datastream").alias("kind"), _get("$.datastream['@iot.id']").alias("stream"), F.lit(0).alias("position"), _get("$.datastream.Thing['@iot.id']").alias("thing"), _get("$.datastream.Thing.name").alias("thing_name"), _get("$.datastream.ObservedProperty.name").alias("property"), _get("$.datastream.unitOfMeasurement.symbol").alias("unit"), _get("$.datastream.Thing.Locations", "variant").alias("locations"))
    many = lines.where("kind = 'multiDatastream'").select(_get("$.multiDatastream['@iot.id']").alias("stream"), _get("$.multiDatastream.Thing['@iot.id']").alias("thing"), _get("$.multiDatastream.Thing.name").alias("thing_name"), _get("$.multiDatastream.Thing.Locations", "variant").alias("locations"), F.posexplode(F.arrays_zip(_get("$.multiDatastream.ObservedProperties", "array<variant>").alias("p"), _get("$.multiDatastream.unitOfMeasurements", "array<variant>").alias("u"))).alias("position", "x"))
    many = many.select(F.lit("multiDatastream").alias("kind"), "stream", "position", "thing", "thing_name", F.try_variant_get("x.p", "$.name", "string").alias("property"), F.try_variant_get("x.u", "$.symbol", "string").alias("unit"), "locations")
    return one.unionByName(many)


def reading_keys(catalog: DataFrame) -> DataFrame:
    """The key of each reading of a thing: the first holder of a name keeps it, others get their stream's id, and in
    streams of several results the position."""
    from pyspark.sql import Window

    order = Window.partitionBy("thing", "property").orderBy("kind", F.col("stream").try_cast("long").isNull(), F.col("stream").try_cast("long"), "stream", "position")
    other = F.when(F.col("kind") == "multiDatastream", F.concat("property", F.lit("@"), "stream", F.lit("/"), F.col("position").cast("string"))).otherwise(F.concat("property", F.lit("@"), "stream"))
    return catalog.withColumn("key", F.when(F.row_number().over(order) == 1, F.col("property")).otherwise(other))


def observations(lines: DataFrame) -> DataFrame:
    """Observation, stream and thing, a row per result: scalar results at position 0, arrays by position."""
    rows = lines.where("kind = 'observation'").select(_get("$.observation['@iot.id']").alias("observation"), F.when(_get("$.datastream").isNotNull(), "datastream").otherwise("multiDatastream").alias("kind"), F.coalesce(_get("$.datastream"), _get("$.multiDatastream")).alias("stream"), instant(_get("$.observation.phenomenonTime")).alias("at"), _get("$.observation.result", "variant").alias("result"))
    values = F.when(F.col("kind") == "multiDatastream", F.try_variant_get("result", "$", "array<variant>")).otherwise(F.array("result"))
    rows = rows.select("observation", "kind", "stream", "at", F.posexplode(values).alias("position", "value"))
    catalog = reading_keys(streams(lines)).drop("locations")
    return rows.join(catalog, ["kind", "stream", "position"])


def latest(lines: DataFrame) -> DataFrame:
    """A row per thing with its streams' newest results by reading key."""
    own = lines.where("kind = 'datastream'").select(F.lit("datastream").alias("kind"), _get("$.datastream['@iot.id']").alias("stream"), F.lit(0).alias("position"), F.explode(_get("$.datastream.Observations", "array<variant>")).alias("o"))
    own = own.select("kind", "stream", "position", instant(F.try_variant_get("o", "$.phenomenonTime", "string")).alias("at"), F.try_variant_get("o", "$.result", "string").alias("value"))
    newest = own.groupBy("kind", "stream", "position").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    joined = reading_keys(streams(lines)).drop("locations").join(newest, ["kind", "stream", "position"], "left")
    readings = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("key", F.struct("value", "at", "unit"))))))
    return joined.groupBy("thing").agg(F.first("thing_name").alias("name"), readings.alias("readings"))


def locations(lines: DataFrame) -> DataFrame:
    """Per thing its GeoJSON location with the lowest id, numbers before texts."""
    from_streams = streams(lines).select("thing", "locations")
    things = lines.where("kind = 'thing'").select(_get("$.thing['@iot.id']").alias("thing"), _get("$.thing.Locations", "variant").alias("locations"))
    each = from_streams.unionByName(things).select("thing", F.explode(F.try_variant_get("locations", "$", "array<variant>")).alias("l"))
    each = each.select("thing", F.try_variant_get("l", "$['@iot.id']", "string").alias("id"), F.to_json(F.try_variant_get("l", "$.location", "variant")).alias("geometry"), F.try_variant_get("l", "$.encodingType", "string").alias("encoding"))
    number = F.col("id").try_cast("long")
    return each.where("encoding in ('application/geo+json', 'application/vnd.geo+json')").groupBy("thing").agg(F.min_by("geometry", F.struct(number.isNull(), number, "id")).alias("geometry"))


def historical_locations(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'historicalLocation'").select(_get("$.thing").alias("thing"), temporal.datetime(_get("$.historicalLocation.time")).alias("at"), F.to_json(_get("$.historicalLocation.Locations", "variant")).alias("locations"))


# Requests


def _stamp(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def latest_request(root: str, page: int = 1000) -> str:
    """Streams with their newest observation."""
    expand = "Thing($select=id,name;$expand=Locations),ObservedProperty($select=id,name),Observations($orderby=phenomenonTime desc;$top=1)"
    return f"{root.rstrip('/')}/Datastreams?" + urlencode({"$expand": expand, "$orderby": "id", "$top": page}, safe="$(),;=")


def observations_request(root: str, stream: str, start: datetime | None, end: datetime | None = None, page: int = 1000) -> str:
    """Observations of a stream in [start, end)."""
    parts = [f"phenomenonTime ge {_stamp(start)}"] * (start is not None) + [f"phenomenonTime lt {_stamp(end)}"] * (end is not None)
    key = stream if stream.isdigit() else "'" + stream.replace("'", "''") + "'"
    query = {"$filter": " and ".join(parts), "$orderby": "phenomenonTime asc,id asc", "$top": page}
    return f"{root.rstrip('/')}/Datastreams({key})/Observations?" + urlencode({k: v for k, v in query.items() if v != ""}, safe="$(),;=:")


def same_origin(root: str, link: str) -> bool:
    """Whether a next link stays on the server that it came from."""
    from urllib.parse import urlsplit

    return urlsplit(root)[:2] == urlsplit(link)[:2]
