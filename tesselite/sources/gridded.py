"""Records of gridded sources: location records, pivots, packing, vertical levels and the classic NetCDF format."""

from __future__ import annotations

import struct
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_longitude(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def pivot_fields(df: DataFrame, keys: list[str], parameter: str, value: str, names: list[str]) -> DataFrame:
    """Fields of one grid, level and time as columns of one record per cell; cells without any value are dropped. The
    names are given, so that Spark needn't scan for them. Rows of other fields go before they are grouped, and a cell's
    columns come of one aggregation, as each further one holds its groups in a task's memory at the same time."""
    kept = df.where(F.col(parameter).isin(names) & F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(*[F.first(F.when(F.col(parameter) == n, F.col(value)), ignorenulls=True).alias(n) for n in names])


def unpack(value: Column, scale: float | None = None, offset: float | None = None, fill: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """Packed values: fill and values out of the valid range are null, then scaled and shifted."""
    x = value if fill is None else F.when(value != fill, value)
    x = x if low is None else F.when(x >= low, x)
    x = x if high is None else F.when(x <= high, x)
    if scale is not None or offset is not None:
        x = x.cast("double") * F.lit(1.0 if scale is None else scale) + F.lit(0.0 if offset is None else offset)
    return x


def single_precision(x: Column) -> Column:
    """A 32-bit float as the double with the same shortest decimal."""
    return x.cast("float").cast("string").cast("double")


def location_number(x: Column) -> Column:
    """Whole floats as integers, in text."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


#: Units of levels with the factor to the canonical unit.
LEVELS = {"Pa": ("hPa", 0.01), "hPa": ("hPa", 1.0), "mbar": ("hPa", 1.0), "kPa": ("hPa", 10.0), "m": ("m", 1.0), "km": ("m", 1000.0), "cm": ("m", 0.01), "K": ("K", 1.0), "1": ("1", 1.0)}


def level(value: Column, unit: Column) -> tuple[Column, Column]:
    """A vertical level in its canonical unit."""
    factor = F.create_map(*[F.lit(x) for u, (_, f) in LEVELS.items() for x in (u, f)])
    name = F.create_map(*[F.lit(x) for u, (n, _) in LEVELS.items() for x in (u, n)])
    return value.cast("double") * F.coalesce(F.try_element_at(factor, unit), F.lit(1.0)), F.coalesce(F.try_element_at(name, unit), unit)


#: Fixed values of the CF conventions: standard names and units that tell a coordinate's role.
_ROLES = {"latitude": "latitude", "longitude": "longitude", "time": "time", "air_pressure": "vertical", "height": "vertical", "altitude": "vertical", "depth": "vertical"}
_ROLE_UNITS = {"degrees_north": "latitude", "degree_north": "latitude", "degrees_N": "latitude", "degrees_east": "longitude", "degree_east": "longitude", "degrees_E": "longitude"}
_ROLE_AXES = {"X": "longitude", "Y": "latitude", "Z": "vertical", "T": "time"}


def role(attributes: dict) -> str | None:
    """By standard name, then units, then axis, then positive."""
    units = str(attributes.get("units", ""))
    return _ROLES.get(attributes.get("standard_name", "")) or _ROLE_UNITS.get(units) or ("time" if " since " in units else None) or _ROLE_AXES.get(attributes.get("axis", "")) or ("vertical" if "positive" in attributes else None)


def decode_time(values, units: str, calendar: str = "standard") -> list[str]:
    """Offsets from an epoch as text; calendars of equal months are labels, not instants."""
    step, _, epoch = units.partition(" since ")
    seconds = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600, "d": 86400, "day": 86400}[next(k for k in ("sec", "min", "hr", "day", "h", "s", "m", "d") if step.strip().lower().startswith(k))]
    base = epoch.strip().replace("T", " ").removesuffix("Z").removesuffix("UTC").strip()
    date, _, time = base.partition(" ")
    y, m, d = (int(x) for x in date.split("-"))
    hour, minute, second = ([*map(float, (time or "0").split(":")), 0, 0, 0])[:3]
    start = hour * 3600 + minute * 60 + second
    lengths = {"noleap": 365, "365_day": 365, "all_leap": 366, "366_day": 366, "360_day": 360}.get(calendar)
    out = []
    for v in values:
        total = float(v) * seconds + start
        if lengths is None:
            out.append((datetime(y, m, d) + timedelta(seconds=round(total, 6))).isoformat() + "Z")
            continue
        months = [30] * 12 if lengths == 360 else [31, 29 if lengths == 366 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
        day = y * lengths + sum(months[: m - 1]) + d - 1 + int(total // 86400)
        rest, year, within, month = total % 86400, day // lengths, day % lengths, 0
        while within >= months[month]:
            within, month = within - months[month], month + 1
        out.append(f"{year:04d}-{month + 1:02d}-{within + 1:02d}T{int(rest // 3600):02d}:{int(rest % 3600 // 60):02d}:{int(rest % 60):02d}")
    return out


_KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


def parse_netcdf(data: bytes) -> tuple[dict[str, int], dict, dict[str, tuple[list[str], dict, np.ndarray]]]:
    """Dimensions, attributes and variables of a classic file (CDF-1, CDF-2, CDF-5)."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("only the classic NetCDF formats are read")
    version, at = data[3], 4

    def number(wide: bool = False) -> int:
        nonlocal at
        form = ">q" if wide else ">i"
        (x,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return x

    count = lambda: number(version == 5)

    def name() -> str:
        nonlocal at
        n = count()
        out = data[at : at + n].decode()
        at += n + -n % 4
        return out

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(count()):
            key, kind, n = name(), number(), count()
            size = np.dtype(_KINDS[kind]).itemsize * n
            raw = data[at : at + size]
            at += size + -size % 4
            values = raw.rstrip(b"\0").decode(errors="replace") if kind == 2 else np.frombuffer(raw, _KINDS[kind])
            out[key] = values if kind == 2 else values[0].item() if n == 1 else values.tolist()
        return out

    records = count()
    number()
    dims = [(name(), count()) for _ in range(count())]
    whole = attributes()
    number()
    made = []
    for _ in range(count()):
        key = name()
        ids = [count() for _ in range(count())]
        own, kind, size, begin = attributes(), number(), count(), number(version != 1)
        made.append((key, ids, own, kind, size, begin))
    stride = sum(size for _, ids, _, _, size, _ in made if ids and dims[ids[0]][1] == 0)
    out = {}
    for key, ids, own, kind, _, begin in made:
        shape, form = [dims[i][1] for i in ids], np.dtype(_KINDS[kind])
        if ids and shape[0] == 0:
            per = int(np.prod(shape[1:], dtype=np.int64))
            values = np.stack([np.frombuffer(data, form, per, begin + r * stride) for r in range(records)]) if records else np.zeros((0, per), form)
            shape[0] = records
        else:
            values = np.frombuffer(data, form, int(np.prod(shape, dtype=np.int64)), begin)
        out[key] = ([dims[i][0] for i in ids], own, values.reshape(shape))
    return {n: records if s == 0 else s for n, s in dims}, whole, out


def netcdf_records(data: bytes) -> pd.DataFrame:
    """A row per cell and variable of a grid: latitude, longitude, time, level, name, value. Fill values are dropped."""
    _, _, variables = parse_netcdf(data)
    roles = {n: role(own) for n, (_, own, _) in variables.items() if n in variables[n][0]}
    frames = []
    for key, (dims, own, values) in variables.items():
        if key in roles or not dims or values.dtype.kind == "S" or not any(roles.get(d) == "latitude" for d in dims):
            continue
        grid = np.meshgrid(*[np.arange(s) for s in values.shape], indexing="ij")
        flat = values.ravel().astype(np.float64)
        keep = np.isfinite(flat)
        for fill in ("_FillValue", "missing_value"):
            if fill in own:
                keep &= values.ravel() != own[fill]
        flat = flat * own.get("scale_factor", 1.0) + own.get("add_offset", 0.0)
        if values.dtype.itemsize == 4 and values.dtype.kind == "f" and "scale_factor" not in own:
            flat = np.array([float(str(x)) for x in values.ravel().astype(np.float32)])
        row = {"name": key, "value": flat[keep]}
        for d, g in zip(dims, grid, strict=True):
            if d in variables and (r := roles.get(d)):
                _, axis, at = variables[d]
                points = decode_time(at, axis["units"], axis.get("calendar", "standard")) if r == "time" else at.astype(float)
                row[r] = np.array(points)[g.ravel()[keep]]
        frames.append(pd.DataFrame(row))
    out = pd.concat(frames) if frames else pd.DataFrame()
    for c in ("latitude", "longitude", "time", "vertical", "name", "value"):
        if c not in out:
            out[c] = None
    if len(out):
        out["longitude"] = (out["longitude"].astype(float) + 180) % 360 - 180
    return out[["latitude", "longitude", "time", "vertical", "name", "value"]]


def read_netcdf(spark: SparkSession, path: str) -> DataFrame:
    """Files are read by Spark, so any store that it knows will do; one task per file."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield netcdf_records(bytes(data))

    return files.mapInPandas(rows, "latitude double, longitude double, time string, vertical double, name string, value double")
