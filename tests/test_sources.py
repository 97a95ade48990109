from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesselite.functions import units
from tesselite.operators import represent, resolve, validate
from tesselite.sources import delimited, documents, gridded, sinks, vector
from tesselite.streaming import incremental, schedule


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Title of it\nname;x;x;\nA;1,5;007;\nB;2;true;\nshort;1\nC;abc;;\n")
    d = delimited.Dialect(";", skip_rows=1, decimal_separator=",")
    df = delimited.read_delimited(spark, str(path), d)
    assert df.columns[:3] == ["name", "x", "x@3"]
    rows = df.where("_ok").select(F.col("name").cast("string"), F.col("x").cast("string"), F.col("`x@3`").cast("string")).collect()
    assert [tuple(r) for r in rows] == [("A", "1.5", "007"), ("B", "2", "true"), ("C", "abc", None)]
    assert df.where("not _ok").count() == 1


@pytest.mark.parametrize("above", ["", "Title of it\n"])
def test_delimited_keeps_rows_equal_to_the_header(spark, tmp_path, above):
    for k in range(3):  # files of different sizes
        (tmp_path / f"{k}.csv").write_text(f"{above}id,name\n1,x{k}\nid,name\n" + "2,y\n" * k)
    d = delimited.Dialect(",", skip_rows=1 if above else 0)
    rows = delimited.read_delimited(spark, str(tmp_path), d, typed=False).where("_ok").collect()
    want = [row for k in range(3) for row in [("1", f"x{k}"), ("id", "name"), *[("2", "y")] * k]]
    assert sorted((r["id"], r["name"]) for r in rows) == sorted(want)


def test_unit_symbols_by_case(spark):
    rows = spark.createDataFrame([("S",), ("s",), ("h",), ("H",), ("KM",), ("Celsius",)], "x string").select(units.code(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["SIE", "SEC", "HUR", "81", "KMT", "CEL"]


def test_quoted_keeps_null_and_escapes(spark):
    rows = spark.createDataFrame([(None,), ("",), ('a"}b\n',)], "x string").select(represent.quoted(F.col("x"))).collect()
    assert [r[0] for r in rows] == [None, '""', json.dumps('a"}b\n')]


def test_dialect():
    d = delimited.detect("a;b;c\n1,5;x;2020-01-01\n2,5;y;2020-01-02\n")
    assert (d.delimiter, d.header, d.decimal_separator) == (";", True, ",")
    assert delimited.detect("1|2\n3|4\n").header is False
    assert delimited.keys([["a", "", "a"], ["x", "", "x"]]) == ["a x", "1", "a x@3"]
    assert delimited.encoding_of("ž".encode("utf-16-le") * 0 + "abc".encode("utf-16-le")) == "UTF-16LE"
    assert delimited.encoding_of("müll".encode("latin-1") * 5) == "windows-1252"


@pytest.mark.parametrize("data,kind", [(b"GRIB....", "grib"), (b"SQLite format 3\0", "geopackage"), (b"CDF\x01", "netcdf"), (b'{"type": "FeatureCollection"}', "geojson"), (b"[1]", "json"), (b"<a/>", "xml"), (b'<kml xmlns="x"/>', "kml"), (b"a,b", "csv")])
def test_formats(data, kind):
    assert delimited.detect_format(data) == kind


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1, "rows": [{"a": 1}, {"a": null}]}')
    assert [json.loads(r.record) for r in documents.read_json(spark, str(tmp_path / "a.json")).orderBy("position").collect()] == [{"a": 1}, {"a": None}]
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "name": "N", "features": [{"type": "Feature", "id": 7, "properties": {"p": 1}, "geometry": null}]}')
    assert json.loads(documents.read_geojson(spark, str(tmp_path / "a.geojson")).first().record) == {"id": 7, "properties": {"p": 1}, "geometry": None, "featureCollection": {"name": "N"}}
    assert documents.split_xml("<r><i k='1'>a</i><i>b</i><o/></r>") == [{"@k": "1", "#text": "a"}, {"#text": "b"}]
    assert documents.split_xml("<r><i>a</i><o/></r>") == [{"i": "a", "o": None}]
    nested = spark.createDataFrame([(1, "p", [("x", 5), ("y", 6)])], "id int, name string, items array<struct<name:string,v:int>>")
    assert [tuple(r) for r in documents.split_collection(nested, "items").orderBy("v").collect()] == [(1, "x", 5), (1, "y", 6)]
    assert json.loads(spark.range(1).select(documents.drop_nulls(F.lit('{"a":null,"b":[1,null,{"c":null}]}')).alias("x")).first().x) == {"b": [1, {}]}


def test_kml():
    data = b"<kml xmlns='http://x'><Document><Folder><name>Bike Stops</name><Placemark><name>A</name><TimeSpan><begin>2020</begin></TimeSpan><ExtendedData><Data name='k'><value>v</value></Data></ExtendedData><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark></Folder></Document></kml>"
    assert list(vector.parse_kml(data)) == [("Bike Stops", {"name": "A", "begin": "2020", "k": "v", "namespace": "bike_stops"}, {"type": "MultiPoint", "coordinates": [[1.0, 2.0], [3.0, 4.0]]})]


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.executescript("CREATE TABLE gpkg_contents(table_name, data_type); CREATE TABLE gpkg_geometry_columns(table_name, column_name, srs_id); CREATE TABLE t(id INTEGER, g BLOB); INSERT INTO gpkg_contents VALUES('t', 'features'); INSERT INTO gpkg_geometry_columns VALUES('t', 'g', 4326);")
    db.execute("INSERT INTO t VALUES(1, ?)", (b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BIdd", 1, 1, 14.5, 46.0),))
    db.commit()
    db.close()
    r = vector.read_geopackage(spark, str(tmp_path / "a.gpkg")).first()
    assert (r.collection, json.loads(r.properties), json.loads(r.geometry)) == ("t", {"id": 1}, {"type": "Point", "coordinates": [14.5, 46.0]})


def test_shapefile():
    shape = struct.pack("<idd", 1, 1.0, 2.0)
    shp = b"\0" * 100 + struct.pack(">ii", 1, len(shape) // 2) + shape
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    dbf = struct.pack("<BBBBIHH", 3, 0, 0, 0, 1, 32 + 32 + 1, 6) + b"\0" * 20 + field + b"\x0d" + b" " + b"abc  "
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("l.shp", shp)
        z.writestr("l.dbf", dbf)
    assert list(vector.parse_shapefile_zip(out.getvalue())) == [(None, {"NAME": "abc"}, {"type": "Point", "coordinates": [1.0, 2.0]})]


def _netcdf() -> bytes:
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + v.encode().ljust(-(-len(v) // 4) * 4, b"\0")
    atts = lambda a: struct.pack(">ii", 12 if a else 0, len(a)) + b"".join(text(k, v) for k, v in a)

    def build(begins):
        head = b"CDF\1" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + name("lat") + struct.pack(">i", 2) + name("lon") + struct.pack(">i", 2) + atts([]) + struct.pack(">ii", 11, 3)
        for (key, ids, a, kind, size), begin in zip((("lat", [0], [("units", "degrees_north")], 6, 16), ("lon", [1], [("units", "degrees_east")], 6, 16), ("t", [0, 1], [], 5, 16)), begins, strict=True):
            head += name(key) + struct.pack(">i", len(ids)) + b"".join(struct.pack(">i", i) for i in ids) + atts(a) + struct.pack(">iii", kind, size, begin)
        return head

    n = len(build((0, 0, 0)))
    return build((n, n + 16, n + 32)) + struct.pack(">dd", 10, 20) + struct.pack(">dd", 190, 30) + struct.pack(">ffff", 0.1, 2, 3, 4)


def test_netcdf():
    out = gridded.netcdf_records(_netcdf())
    assert out[["latitude", "longitude", "value"]].values.tolist() == [[10, -170, 0.1], [10, 30, 2], [20, -170, 3], [20, 30, 4]]
    assert gridded.decode_time([0, 60], "days since 2000-01-01", "360_day") == ["2000-01-01T00:00:00", "2000-03-01T00:00:00"]
    assert gridded.decode_time([1.5], "hours since 2000-01-01 00:00:00") == ["2000-01-01T01:30:00Z"]


def test_pivot_fields(spark):
    rows = [(1, "a", None), (1, "a", 2.5), (1, "b", float("inf")), (1, "c", 7.0), (2, "b", None), (3, "c", 1.0), (3, None, 1.0), (4, "b", 0.0), (None, "a", 4.0)]
    out = gridded.pivot_fields(spark.createDataFrame(rows, "cell int, name string, v double"), ["cell"], "name", "v", ["a", "b", "absent"])
    assert out.columns == ["cell", "a", "b", "absent"]
    assert {tuple(r) for r in out.collect()} == {(1, 2.5, float("inf"), None), (4, None, 0.0, None), (None, 4.0, None, None)}
    # Other fields go before grouping, and there is one grouping: each holds its groups in a task's memory.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Filter" in plan.split("Aggregate")[1]


def test_static_merge(spark):
    df = spark.createDataFrame([("K", 1, None), ("K", 2, 5)], "id string, pos int, a int")
    assert resolve.static_merge(df, "id", "pos", ["a"]).first().a is None
    assert resolve.static_merge(df, "id", "pos", ["a"], {"a": F.col("a").isNotNull()}).first().a == 5


def test_expiry_and_lists(spark):
    df = spark.createDataFrame([("K", 1, "U2", 10), ("K", 2, "U1", None), ("K", 3, "U2", 7)], "id string, pos int, t string, e int")
    assert resolve.list_targets(df, "id", "pos", "t").first().t == ["U2", "U1"]
    assert resolve.single_target(df, "id", "pos", "t").first().t == "U2"
    assert resolve.expiry_static(df, "id", "pos", "e").first().e == 7
    assert resolve.expiry_join(df, "id", "e").first().e is None


def test_schema(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"anyOf": [{"type": "string"}, {"type": "null"}]}}, "$defs": {"n": {"type": "integer", "minimum": 3}}}
    df = spark.createDataFrame([('{"a": 5, "b": null}',), ('{"a": 2, "b": 1}',), ("{}",)], "e string")
    got = [r.v for r in df.select(validate.check(F.col("e"), schema).alias("v")).collect()]
    assert got == [[], ["/a: minimum", "/b: anyOf"], ["/: required a"]]
    assert validate.repair({"$ref": "x#/d"}, {"x": {"d": {"type": "null"}}}) == {"type": "null"}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("A", '{"id":1}'), ("A", '{"id":2}'), ("B", '{"id":3}')], "type string, entity string").coalesce(1)
    sinks.write_files(df, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines/type=A")).collect()) == ['{"id":1}', '{"id":2}']
    sinks.write_files(df, str(tmp_path / "arrays"), "array")
    (part,) = (tmp_path / "arrays/type=A").glob("part-*")
    assert json.loads(part.read_text()) == [{"id": 1}, {"id": 2}]
    mixed = spark.range(3000).selectExpr("if(id % 3 = 0, 'A', concat('T', id % 5)) type", "concat('{\"id\":', id, '}') entity").coalesce(1)
    sinks.write_files(mixed, str(tmp_path / "mixed"), "array")
    for kind in ("A", "T0", "T4"):
        (part,) = (tmp_path / f"mixed/type={kind}").glob("part-*")
        ids = [e["id"] for e in json.loads(part.read_text())]
        assert ids == sorted(ids) and len(ids) == mixed.where(F.col("type") == kind).count()


def test_broker():
    sent = []

    def post(url, body, headers):
        ids = [e["id"] for e in json.loads(body)]
        sent.append(ids)
        if len(ids) > 2:
            return 413, ""
        if "bad" in ids:
            return (400, "no") if len(ids) == 1 else (207, json.dumps({"errors": [{"entityId": "bad", "error": "x"}]}))
        return 204, ""

    b = sinks.Broker("http://h", post=post, backoff=0)
    assert b.deliver([json.dumps({"id": i}) for i in ("a", "b", "c", "bad")]) == (3, [("bad", "x")])
    assert sinks.masked("http://u:p@h/x?k=1") == "http://…@h/x?…"


def test_incremental(spark, tmp_path):
    store = incremental.PositionStore(spark, str(tmp_path / "positions"))
    read = []

    def day(rows):
        return spark.createDataFrame([(s, i, datetime(2024, 1, 1, h, m)) for s, i, h, m in rows], "s string, i string, at timestamp")

    def write(df):
        read.append(sorted(r.i for r in df.collect()))

    incremental.cycle(store, day([("a", "1", 10, 0), ("b", "2", 10, 0)]), write, "s", "i", "at", 3600)
    incremental.cycle(store, day([("a", "1", 10, 0), ("a", "3", 9, 30), ("a", "4", 8, 0), ("a", "5", 11, 0)]), write, "s", "i", "at", 3600)
    incremental.cycle(store, day([("a", "3", 9, 30), ("a", "5", 11, 0), ("b", "2", 10, 0)]), write, "s", "i", "at", 3600)
    # Late within the lookback: once; older: never.
    assert read == [["1", "2"], ["3", "5"], []]

    def fail(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        incremental.cycle(store, day([("b", "9", 12, 0)]), fail, "s", "i", "at", 3600)
    incremental.cycle(store, day([("b", "9", 12, 0)]), write, "s", "i", "at", 3600)
    assert read[-1] == ["9"]
    missing = incremental.mark_missing(store.load(), day([("a", "1", 1, 1)]), "s")
    assert {r.stream: r.missing for r in missing.collect()} == {"a": False, "b": True}
    assert incremental.reset(store.load(), ["a"]).count() == 1


def test_latest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, t int, v double")
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.latest_stream(stream, "k", "t", str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/0")).collect()) == [("a", 2, 2.0), ("b", 1, 3.0)]


def test_schedule():
    assert schedule.duration("1h30m") == 5400
    assert schedule.next_cron("0 30 9 * * MON-FRI", datetime(2024, 1, 5, 10)) == datetime(2024, 1, 8, 9, 30)
    assert schedule.next_cron("0 0 0 29 2 ?", datetime(2023, 1, 1)) == datetime(2024, 2, 29)
    assert schedule.next_time("09:00", datetime(2024, 1, 1, 10)) == datetime(2024, 1, 2, 9)
    calls, slept = [], []

    def job():
        calls.append(1)
        if len(calls) in (2, 3):
            raise ValueError

    s = schedule.Schedule("every", "10s", repeat=3, attempts=2, on_failure="continue", sleep=slept.append)
    assert s.run(job) == {"succeeded": 2, "failed": 1}
    assert slept == [10, 5, 10]
