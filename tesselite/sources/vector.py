"""KML, KMZ, Shapefile and GeoPackage. Spark reads the files whole, so any store that it knows will do; each file is
parsed in one task."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import geometry as G

SCHEMA = "collection string, properties string, geometry string"


def _snake(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text).lower()).strip("_")


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _positions(text: str) -> list:
    return [[float(x) for x in p.split(",")] for p in (text or "").split()]


def kml_geometry(e) -> dict | None:
    kind = _tag(e)
    find = lambda path: [x for x in e.iter() if _tag(x) == path]
    if kind == "Point":
        return {"type": "Point", "coordinates": _positions(find("coordinates")[0].text)[0]}
    if kind in ("LineString", "LinearRing"):
        return {"type": "LineString", "coordinates": _positions(find("coordinates")[0].text)}
    if kind == "Polygon":
        outer = [c for b in find("outerBoundaryIs") for c in b.iter() if _tag(c) == "coordinates"]
        inner = [c for b in find("innerBoundaryIs") for c in b.iter() if _tag(c) == "coordinates"]
        return {"type": "Polygon", "coordinates": [_positions(c.text) for c in (*outer[:1], *inner)]}
    if kind == "MultiGeometry":
        parts = [g for c in e if (g := kml_geometry(c))]
        return G.fold_collection({"type": "GeometryCollection", "geometries": parts})
    return None


def parse_kml(data: bytes):
    """(collection, properties, geometry) per placemark; folders are collections, extended data and times properties."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))

    def walk(e, folder):
        for c in e:
            kind = _tag(c)
            if kind in ("Folder", "Document"):
                name = next((x.text for x in c if _tag(x) == "name"), None)
                yield from walk(c, name if kind == "Folder" else folder)
            elif kind == "Placemark":
                properties, shape = {}, None
                for x in c:
                    t = _tag(x)
                    if t in ("name", "description", "address"):
                        properties[t] = (x.text or "").strip()
                    elif t == "TimeStamp":
                        properties["when"] = next((w.text for w in x.iter() if _tag(w) == "when"), None)
                    elif t == "TimeSpan":
                        properties |= {_tag(w): w.text for w in x if _tag(w) in ("begin", "end")}
                    elif t == "ExtendedData":
                        for d in x.iter():
                            if _tag(d) == "Data":
                                properties[d.get("name")] = next((v.text for v in d if _tag(v) == "value"), None)
                            elif _tag(d) == "SimpleData":
                                properties[d.get("name")] = d.text
                    elif t in ("Point", "LineString", "LinearRing", "Polygon", "MultiGeometry"):
                        try:
                            shape = kml_geometry(x)
                        except G.GeometryError:
                            shape = None
                if folder:
                    properties["namespace"] = _snake(folder)
                yield folder, properties, shape
            else:
                yield from walk(c, folder)

    yield from walk(ElementTree.fromstring(data), None)


def parse_dbf(data: bytes, encoding: str = "utf-8") -> list[dict]:
    n, start, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name, kind, length = data[at : at + 11].split(b"\0")[0].decode(), chr(data[at + 11]), data[at + 16]
        fields.append((name, kind, length))
        at += 32
    out = []
    for r in range(n):
        at, row = start + r * size + 1, {}
        for name, kind, length in fields:
            raw = data[at : at + length].decode(encoding, errors="replace").strip()
            at += length
            if kind in "NF":
                row[name] = None if not raw or raw[0] == "*" else float(raw) if "." in raw or "e" in raw.lower() else int(raw)
            elif kind == "L":
                row[name] = {"Y": True, "T": True, "N": False, "F": False}.get(raw.upper())
            elif kind == "D":
                row[name] = f"{raw[:4]}-{raw[4:6]}-{raw[6:]}" if len(raw) == 8 else None
            else:
                row[name] = raw or None
        if data[start + r * size] != 0x2A:
            out.append(row)
    return out


def parse_shp(data: bytes) -> list[dict | None]:
    out, at = [], 100
    while at + 12 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack_from("<i", body)
        base = kind % 10
        if kind == 0:
            out.append(None)
        elif base == 1:
            out.append({"type": "Point", "coordinates": list(struct.unpack_from("<2d", body, 4))})
        elif base == 8:
            (n,) = struct.unpack_from("<i", body, 36)
            out.append({"type": "MultiPoint", "coordinates": [list(struct.unpack_from("<2d", body, 40 + 16 * k)) for k in range(n)]})
        else:
            parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            first = 44 + 4 * parts
            lines = [[list(struct.unpack_from("<2d", body, first + 16 * k)) for k in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            if base == 3:
                out.append({"type": "LineString", "coordinates": lines[0]} if parts == 1 else {"type": "MultiLineString", "coordinates": lines})
            else:  # outer rings run clockwise here, holes the other way
                areas: list[list] = []
                for r in lines:
                    if G.ring_area(r) <= 0 or not areas:
                        areas.append([r])
                    else:
                        areas[-1].append(r)
                g = {"type": "Polygon", "coordinates": areas[0]} if len(areas) == 1 else {"type": "MultiPolygon", "coordinates": areas}
                out.append(G.wind(g))
    return out


def parse_shapefile_zip(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        layers = sorted(n[:-4] for n in z.namelist() if n.lower().endswith(".shp"))
        for layer in layers:
            crs = z.read(f"{layer}.prj").decode(errors="replace") if f"{layer}.prj" in z.namelist() else ""
            code = _crs(crs)
            for properties, shape in zip(parse_dbf(z.read(f"{layer}.dbf")), parse_shp(z.read(f"{layer}.shp")), strict=False):
                yield layer.rpartition("/")[2] if len(layers) > 1 else None, properties, shape and G.reproject(shape, code)


def _crs(wkt: str) -> str:
    """An EPSG code, as far as the few systems that are read can be told from their text."""
    if found := re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]\]\s*$', wkt):
        return found[-1]
    if re.search("Mercator_Auxiliary_Sphere|Pseudo-Mercator", wkt):
        return "3857"
    if m := re.search(r"UTM[ _]zone[ _](\d+)([NS])", wkt, re.I):
        return f"32{'6' if m[2].upper() == 'N' else '7'}{int(m[1]):02d}"
    return "4326" if not wkt or wkt.lstrip().startswith(("GEOGCS", "GEOGCRS")) else wkt[:20]


def parse_geopackage(data: bytes, tables: list[str] | None = None):
    """Features and attributes of the listed tables (by default all); a file in write-ahead mode is refused."""
    if data[18] == 2 or data[19] == 2:
        raise ValueError("a GeoPackage in write-ahead mode must be checkpointed first")
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    listed = db.execute("SELECT table_name, data_type FROM gpkg_contents WHERE data_type IN ('features', 'attributes') ORDER BY table_name").fetchall()
    geometry = dict(db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall())
    srs = dict(db.execute("SELECT table_name, srs_id FROM gpkg_geometry_columns").fetchall())
    for name, _ in listed:
        if tables is not None and name not in tables:
            continue
        try:
            rows = db.execute(f'SELECT * FROM "{name}"')
        except sqlite3.DatabaseError:
            continue
        columns = [d[0] for d in rows.description]
        for r in rows:
            row = dict(zip(columns, r, strict=True))
            raw = row.pop(geometry.get(name, ""), None)
            shape = G.reproject(G.load(G.from_wkb(raw)), str(srs[name])) if raw else None
            yield name, {k: v for k, v in row.items() if not isinstance(v, bytes)}, shape


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches):
        for pdf in batches:
            for data in pdf["content"]:
                out = [(c, json.dumps(p, ensure_ascii=False), None if g is None else json.dumps(g)) for c, p, g in parse(bytes(data))]
                yield pd.DataFrame(out, columns=["collection", "properties", "geometry"])

    return files.mapInPandas(rows, SCHEMA)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_kml)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Zipped shapefiles."""
    return _read(spark, path, parse_shapefile_zip)


def read_geopackage(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    return _read(spark, path, lambda data: parse_geopackage(data, tables))
