"""Delimited text: dialects, headers, row widths and values typed one by one."""

from __future__ import annotations

import codecs
import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts

_NUMBER = re.compile(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}|^\d{1,2}[./]\d{1,2}[./]\d{2,4}")


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    skip_rows: int = 0
    header: bool = True
    header_rows: int = 1
    encoding: str = "UTF-8"
    decimal_separator: str = "."
    null_values: tuple[str, ...] = ()


def encoding_of(data: bytes, hint: str | None = None) -> str:
    """By byte-order mark, then UTF-16 without one (by its zero bytes), then UTF-8 if it decodes, else the hint or
    Windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if data.startswith(mark):
            return name
    if len(data) >= 4:
        odd, even = data[1::2].count(0), data[::2].count(0)
        if odd > 0.4 * len(data) / 2 and even == 0:
            return "UTF-16LE"
        if even > 0.4 * len(data) / 2 and odd == 0:
            return "UTF-16BE"
    try:
        data[: len(data) - 3].decode("utf-8") if len(data) > 8 else data.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        return hint or "windows-1252"


def kind_of(cell: str) -> str:
    cell = cell.strip()
    if not cell:
        return "empty"
    if _NUMBER.match(cell):
        return "number"
    if _DATE.match(cell):
        return "date"
    return "boolean" if cell.lower() in ("true", "false") else "text"


def score(rows: list[list[str]]) -> float:
    """How much a reading looks like a table: rows of equal width, more than one column, columns of one type."""
    if not rows:
        return 0.0
    widths = [len(r) for r in rows]
    width = max(set(widths), key=widths.count)
    if width < 2:
        return 0.01
    body = [r for r in rows[1:] or rows if len(r) == width]
    kinds = [[kind_of(r[c]) for r in body] for c in range(width)]
    same = sum(max(k.count(x) for x in set(k)) / len(k) for k in kinds if k) / width
    return widths.count(width) / len(widths) * same * (1 - 1 / (width + 1))


def detect(sample: str) -> Dialect:
    """The dialect of a sample by scoring delimiters and quotes, with the rows before the table and its header."""
    best, found = -1.0, Dialect()
    for delimiter in ",;\t|:":
        for quote in "\"'":
            escape = "\\" if f"\\{quote}" in sample else None
            rows = [r for r in csv.reader(io.StringIO(sample), delimiter=delimiter, quotechar=quote, escapechar=escape, doublequote=escape is None) if r]
            s = score(rows[:200]) * (1.0001 if quote == '"' else 1)
            if s > best:
                best, found = s, Dialect(delimiter, quote, escape)
    rows = list(csv.reader(io.StringIO(sample), delimiter=found.delimiter, quotechar=found.quote))
    widths = [len(r) for r in rows if r]
    width = max(set(widths), key=widths.count) if widths else 1
    skip = next((k for k, r in enumerate(rows[:11]) if len(r) == width), 0)
    head = rows[skip] if skip < len(rows) else []
    body = [r for r in rows[skip + 1 :] if len(r) == width]
    named = all(kind_of(c) in ("text", "empty") for c in head) and len(set(head)) == len(head)
    typed = any(kind_of(r[c]) in ("number", "date", "boolean") for r in body[:20] for c in range(width))
    header = bool(head) and named and (typed or any(set(h) - set(r) for h, r in [(head, body[0])]) if body else named)
    decimal = "," if found.delimiter != "," and any(re.fullmatch(r"[+-]?\d+,\d+", c.strip()) for r in body for c in r) else "."
    return Dialect(found.delimiter, found.quote, found.escape, skip, header, 1, "UTF-8", decimal)


def keys(rows: list[list[str]]) -> list[str]:
    """Column names: stacked headers joined, a blank one by its position, a repeated one with its 1-based column."""
    names = [" ".join(p for p in (c.strip() for c in column) if p) for column in zip(*rows, strict=False)]
    out: list[str] = []
    for k, n in enumerate(names):
        n = n or str(k)
        out.append(n if n not in out else f"{n}@{k + 1}")
    return out


def _below(df: DataFrame, rows: list[list[str]], lines: list[str], width: int) -> DataFrame:
    """Rows without those above the table: of the rows of a file's first block that read like one of them, the first in the
    file, as often as it stands there. Equal rows further down stay."""
    raw = F.concat_ws("\u0001", *[F.coalesce(F.col(f"c{k}"), F.lit("")) for k in range(width)])
    read = ["\u0001".join(r) for r in rows]
    which = F.lit(None).cast("string")
    for x, line in zip(read, lines, strict=True):
        which = F.coalesce(which, F.when((raw == x) | F.coalesce(F.col("_bad") == line, F.lit(False)), F.lit(x)))
    place = F.monotonically_increasing_id()
    held = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), place.alias("_at"))
    held = held.withColumn("_is", F.when(F.col("_start") == 0, which))
    times = F.lit(0)
    for x in dict.fromkeys(read):
        times = F.when(F.col("_is") == x, read.count(x)).otherwise(times)
    rank = F.row_number().over(Window.partitionBy("_file", "_is").orderBy("_at"))
    again = held.where("_is is not null").withColumn("_rank", rank).where(F.col("_rank") > times)
    return held.where("_is is null").select(*df.columns).unionByName(again.select(*df.columns))


def read_delimited(spark: SparkSession, path: str, dialect: Dialect | None = None, typed: bool = True) -> DataFrame:
    """Records with ``_ok`` (false where the row's width is wrong). Fields are variants typed value by value, or text.
    Only the head of the file is looked at by the driver; rows are parsed by Spark."""
    if dialect is None:
        dialect = detect("\n".join(r[0] for r in spark.read.text(path).limit(200).collect()))
    options = {"sep": dialect.delimiter, "quote": dialect.quote, "escape": dialect.escape or dialect.quote, "encoding": dialect.encoding, "multiLine": False, "mode": "PERMISSIVE"}
    head = [r[0] for r in spark.read.option("encoding", dialect.encoding).text(path).limit(dialect.skip_rows + dialect.header_rows + 1).collect()]
    parsed = list(csv.reader(head, delimiter=dialect.delimiter, quotechar=dialect.quote))
    table = parsed[dialect.skip_rows :]
    width = len(table[0]) if table else 0
    names = keys(table[: dialect.header_rows]) if dialect.header else [str(k) for k in range(width)]
    schema = T.StructType([*[T.StructField(f"c{k}", T.StringType()) for k in range(width)], T.StructField("_bad", T.StringType())])
    above = dialect.skip_rows + (dialect.header_rows if dialect.header else 0)
    df = spark.read.schema(schema).options(**options, header=above == 1, columnNameOfCorruptRecord="_bad").csv(path)
    if above > 1:
        df = _below(df, [[*cells, *[""] * width][:width] for cells in parsed[:above]], head[:above], width)
    trailing = F.col("_bad").endswith(dialect.delimiter) & (F.size(F.split("_bad", re.escape(dialect.delimiter))) == width + 1)
    ok = F.col("_bad").isNull() | trailing
    value = (lambda k: casts.infer(F.col(f"c{k}"), dialect.null_values, dialect.decimal_separator)) if typed else (lambda k: F.col(f"c{k}"))
    return df.select(*[value(k).alias(n) for k, n in enumerate(names)], ok.alias("_ok"))


#: The bytes by which formats are known.
MAGIC = ((b"GRIB", "grib"), (b"SQLite format 3\0", "geopackage"), (b"CDF", "netcdf"), (b"\x89HDF", "netcdf"), (b"\x00\x00\x27\x0a", "shapefile"))


def detect_format(data: bytes, name: str = "") -> str:
    """The format of a file's first bytes, most certain signs first."""
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    if data.startswith(b"PK"):
        return "kmz" if name.endswith(".kmz") else "shapefile"
    text = data.decode(encoding_of(data), errors="replace").lstrip("﻿ \r\n\t")
    if text.startswith("<"):
        return "kml" if "<kml" in text[:2000] else "xml"
    if text.startswith(("{", "[")):
        if '"@iot' in text[:4000]:
            return "sensorthings"
        return "geojson" if re.search(r'"type"\s*:\s*"(Feature|FeatureCollection)"', text[:4000]) else "json"
    return "csv"
