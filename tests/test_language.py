from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tesselite.functions import casts, geo, geometry, identity, temporal
from tesselite.plans import json5
from tesselite.plans import mapping as M
from tesselite.plans.template import Compiler, TemplateError, reads


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "Ann ", None, 2.5, ["b", "a"], '{"k":3}'), (2, "", "x", -1.0, [], "{}")], "id long, name string, b string, v double, tags array<string>, props string")


CASES = [
    ("{{ id }}", [1, 2]),
    ("{{ name }}-{{ b }}", [None, None]),
    ("{{ b }}", [None, "x"]),
    ("{{ name }}", ["Ann ", ""]),
    ("{{ v | abs | sqrt }}", [2.5**0.5, 1.0]),
    ("{{ 1 + 2 * id }}", [3, 5]),
    ("{{ name | trim | lower }}", ["ann", ""]),
    ("{% if v > 0 %}{{ v }}{% else %}{{ id }}{% endif %}", [2.5, 2.0]),
    ("{{ tags | sort | join(sep='/') }}", ["a/b", ""]),
    ("{% for t in tags %}<{{ t | upper }}>{% endfor %}", ["<B><A>", ""]),
    ("{{ vars.site ~ '/' ~ b }}", ["Lab/", "Lab/x"]),
    ("{{ b | default(value='none') }}", ["none", "x"]),
    ("{{ props | get(key='k') }}", ["3", None]),
    ("x", ["x", "x"]),
    ("{{ tags | length }}", [2, 0]),
    ("{{ 'b' in tags }}", [True, False]),
    ("{{ this['id'] }}", [1, 2]),
    ("{% set q = id * 10 %}{{ q }}", [10, 20]),
    ("{{ wind_direction(u=1, v=0) }}", [270.0, 270.0]),
    ("{{ clamp(value=v, min=0.0, max=1.0) }}", [1.0, 0.0]),
    ("{{ v / 0 }}", [None, None]),
    ("{{ id is odd and not b is defined }}", [True, False]),
]


@pytest.mark.parametrize("template,expected", CASES)
def test_template(df, template, expected):
    rows = df.select("id", Compiler(df, {"site": "Lab"}).compile(template).alias("x")).orderBy("id").collect()
    assert [r.x for r in rows] == expected


def test_template_errors(df):
    for bad in ("{{ v | sqrtt }}", "{% if x %}", "{{ a b }}", "{{ x", "{{ frob(1) }}", "{{ id is oddd }}"):
        with pytest.raises(TemplateError):
            Compiler(df).compile(bad)
    with pytest.raises(TemplateError, match="did you mean 'sqrt'"):
        Compiler(df).compile("{{ v | sqrtt }}")


def test_reads():
    assert reads("{{ a.b }} {% if c > 1 %}{{ this['d e'] }}{% endif %}{{ vars.x }}") == {"a", "c", "d e"}
    assert reads("{{ context }}") == {"*"}


def _one(spark, text, fn):
    return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,expected", [("7.9", 7), ("-7.9", -7), (" 12 ", 12), ("abc", None), ("9223372036854775807", 9223372036854775807), ("9223372036854775808", None), ("5d", None)])
def test_integer(spark, text, expected):
    assert _one(spark, text, casts.integer) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2026", None), ("2026-01", None), ("2026-01-02T03:04:05", None), ("2026-01-02", "2026-01-02T00:00:00Z"), ("2026-01-02T03:04:05.120Z", "2026-01-02T03:04:05.120Z"), ("2026-01-02T03:04:05.123456789Z", "2026-01-02T03:04:05.123456Z"),
        ("2024-06-01T12:00:00+02:00[Europe/Vienna]", "2024-06-01T10:00:00Z"), ("2024-06-01T12:00:00+01:00[Europe/Vienna]", None), ("1/2/2024 03:04", "2024-02-01T03:04:00Z"), ("2024-01-02 03.04", "2024-01-02T03:04:00Z"), ("1700000000", "2023-11-14T22:13:20Z"), ("1700000000123", "2023-11-14T22:13:20.123Z"),
    ],
)
def test_datetime(spark, text, expected):
    assert _one(spark, text, lambda x: temporal.datetime_text(temporal.datetime(x))) == expected


def test_infer(spark):
    texts = ["00123", "12", "1.5", "true", "True", "", "\\N", "x", "-"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", casts.infer(F.col("x"), ("-",)).alias("v"))
    got = df.select("k", F.schema_of_variant("v").alias("t"), F.col("v").cast("string").alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == ["00123", "12", "1.5", "true", "True", None, None, "x", None]
    assert [r.t for r in got][:4] == ["STRING", "BIGINT", "DECIMAL(2,1)", "BOOLEAN"]


def test_identity(spark):
    assert _one(spark, "ß é/1", lambda x: identity.urn("A", x)) == "urn:ngsi-ld:A:sse1"
    assert _one(spark, "—", lambda x: identity.urn("A", x)) is None
    assert _one(spark, "", lambda x: identity.urn("A", F.lit("S-"), x)) is None


SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}


def test_geometry():
    assert geometry.area(SQUARE) == pytest.approx(12308778361.469, rel=1e-5)
    assert geometry.length(SQUARE) == pytest.approx(443770.917, rel=1e-6)
    assert geometry.inverse([0, 0], [1, 0]) == pytest.approx(111319.4908, rel=1e-8)
    assert geometry.convert(SQUARE, "multipolygon")["type"] == "MultiPolygon"
    two = {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[5, 5], [7, 5], [7, 7], [5, 7], [5, 5]]]]}
    with pytest.raises(geometry.GeometryError, match="ambiguous"):
        geometry.convert(two, "polygon")
    assert geometry.convert(two, "polygon", "largest")["coordinates"][0][0] == [5, 5]
    assert geometry.convert(SQUARE, "point", "centroid")["coordinates"] == [0.5, 0.5]
    assert geometry.convert([[0, 0], [0, 1], [1, 1]], "linestring")["type"] == "LineString"
    clockwise = {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [1, 0]]]}
    assert geometry.ring_area(geometry.convert(clockwise, "polygon")["coordinates"][0]) > 0
    assert geometry.convert({"type": "MultiPoint", "coordinates": [[0, 0], [2, 0], [1, 1], [1, 0.2]]}, "polygon", "convex-hull")["coordinates"][0] == [[0, 0], [2, 0], [1, 1], [0, 0]]
    for bad, why in (({"type": "Point", "coordinates": [200, 0]}, "range"), ({"type": "LineString", "coordinates": [[0, 0]]}, "short"), ({"type": "MultiPoint", "coordinates": []}, "empty")):
        with pytest.raises(geometry.GeometryError, match=why):
            geometry.convert(bad, "geometry")
    lon, lat = geometry.reproject({"type": "Point", "coordinates": [500000, 0]}, "EPSG:32633")["coordinates"]
    assert (lon, lat) == (pytest.approx(15), pytest.approx(0))
    lon, lat = geometry.reproject({"type": "Point", "coordinates": [448251.9, 5411943.8]}, "EPSG:32633")["coordinates"]
    assert (lon, lat) == (pytest.approx(14.2951, abs=1e-3), pytest.approx(48.8586, abs=1e-3))
    assert geometry.reproject({"type": "Point", "coordinates": [1113194.9079, 0]}, "3857")["coordinates"][0] == pytest.approx(10)


def test_largest_measures_little(monkeypatch):
    far = [[[6, 2], [9, 2], [9, 5], [6, 5], [6, 2]]]
    two = {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], far]}
    assert geometry.area({"type": "Polygon", "coordinates": far}) == pytest.approx(110593201903.18114, rel=1e-12)
    assert geometry.area({"type": "Polygon", "coordinates": [[[170, 0], [-170, 0], [-170, 10], [170, 10], [170, 0]]]}) == pytest.approx(2474078703809.2007, rel=1e-12)
    counted, authalic = [], geometry._authalic
    monkeypatch.setattr(geometry, "_authalic", lambda s: counted.append(s) or authalic(s))
    assert geometry.convert(two, "polygon", "largest")["coordinates"] == far
    # Two sides of 20 parts and two of 60, each end of a part once and none along a meridian (before: 640).
    assert len(counted) == 2 * 21 + 2 * 61
    counted.clear()
    assert geometry.convert({"type": "MultiPolygon", "coordinates": [far]}, "polygon", "largest")["coordinates"] == far
    assert not counted


def test_kernels_run_on_all_cores(spark, small):
    from tesselite.queries import QUERIES

    # The file is one row group, which one task would take whole.
    for name in ("geo_07_length_of_equator", "geo_13_area_strategies", "geo_16_bbox_center", "geo_19_points_and_parts"):
        assert QUERIES[name](spark, small).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_conversions_read_once(spark, small):
    from tesselite.queries import QUERIES

    ways = {"same": ("geometry", None), "centre": ("point", "centroid"), "line": ("linestring", "exterior-ring"), "ring": ("polygon", "ring"), "larger": ("polygon", "largest"), "typed": ("multipoint", None)}
    odd = [None, "", " ", "nonsense", "5", "[", "[[0,0],[1,1]]", ' [[[0,0],[1,0],[1,1]]]', "[1,2]", json.dumps(SQUARE), '{"type":"Polygon","coordinates":[]}', '{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1]]]}', '{"type":"Point","coordinates":[200,0]}', '{"type":"Point","coordinates":null}', '{"type":"Feature","geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4],[3,5]]}}', '{"type":"GeometryCollection","geometries":[]}', '{"type":"LineString","coordinates":[[0,0],[2,1]]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    got = df.select("i", geo.conversions(F.col("x"), ways).alias("made")).select("i", "made.*").orderBy("i").collect()
    assert got == df.select("i", *[geo.convert(F.col("x"), *way).alias(n) for n, way in ways.items()]).orderBy("i").collect()
    assert got[9].centre == '{"type":"Point","coordinates":[0.5,0.5]}' and got[6].typed and not any(got[3][1:])
    with pytest.raises(ValueError, match="unknown"):
        geo.conversions(F.col("x"), {"a": ("point", "no-such-way")})
    plan = QUERIES["geo_13_area_strategies"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan


@pytest.mark.parametrize("attribute,dealt", [({"type": "GeoProperty", "source": "{{ g }}"}, 1), ({"source": "{{ g }}", "transformation": "point"}, 1), ({"source": "{{ geo_area(value=g) }}"}, 1), ({"source": "{{ g }}"}, 0)])
def test_mapped_geometries_run_on_all_cores(spark, attribute, dealt):
    df = spark.range(1).select("id", F.lit('{"type":"Point","coordinates":[1,2]}').alias("g"))
    out = M.run(df, {"version": "v4", "dataModel": "A", "identity": {"entityName": "{{ id }}"}, "attributes": {"p": attribute}}, "id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == dealt
    assert out.first().id == "urn:ngsi-ld:A:0"


def test_geo_columns(spark):
    got = spark.range(1).select(geo.geohash(F.lit(57.64911), F.lit(10.40744), 11).alias("h"), geo.dms_point(F.lit("46°03'04\"N 14°30'22\"E")).alias("d"), geo.convert(F.lit("nonsense"), "point").alias("n")).first()
    assert got.h == "u4pruydqqvj"
    assert got.d.startswith('{"type":"Point","coordinates":[14.506')
    assert got.n is None


def test_json5():
    assert json5.loads("{a: 1, 'b': [1, 2,], // c\n \"d\": +.5, /* e */ f: 'it\\'s', g: 0x10, h: null}") == {"a": 1, "b": [1, 2], "d": 0.5, "f": "it's", "g": 16, "h": None}
    with pytest.raises(ValueError, match="line 2"):
        json5.loads("{a: 1,\n b 2}")


MAPPING = """{version: "v4", dataModel: "Sensor", identity: {entityName: "S-{{ id }}"}, scope: "/{{ zone }}",
 attributes: {name: {source: "{{ name }}"},
  reading: {source: "{{ v }}", transformation: "float", properties: {observedAt: {source: "{{ at }}"}, unitCode: {source: "CEL"}}},
  owner: {type: "Relationship", syntheticEntity: {dataModel: "Person", identity: {entityName: "{{ owner }}"}, attributes: {nick: {source: "{{ owner }}"}}}},
  tags: {type: "ListProperty", source: "{{ tags }}", transformation: "integer"}}}"""


def test_mapping(spark):
    df = spark.createDataFrame([(1, "a", "K", "x", "1,5", "2024-01-01T10:00:00+02:00", "o", "1 2"), (2, "b", "K", "x", "2.5", "2024-01-01T09:00:00Z", "o", "1 z"), (3, "c", "L", "Novo mesto", "1", "2024-01-01T09:00:00Z", "p", ""), (4, "d", "", "x", "1", "2024-01-01T09:00:00Z", "q", "")], "pos long, name string, id string, zone string, v string, at string, owner string, tags string")
    m = json5.loads(MAPPING)
    got = {r.id: r.entity for r in M.run(df, m, "pos", "concise").collect()}
    # The later instant is kept; a scope that isn't legal and an empty id cost their entity, not the related one.
    assert got == {
        "urn:ngsi-ld:Sensor:S-K": '{"id":"urn:ngsi-ld:Sensor:S-K","type":"Sensor","scope":"/x","name":"b","reading":{"value":2.5,"observedAt":"2024-01-01T09:00:00Z","unitCode":"CEL"},"owner":{"object":"urn:ngsi-ld:Person:o"}}',
        "urn:ngsi-ld:Person:o": '{"id":"urn:ngsi-ld:Person:o","type":"Person","nick":"o"}',
        "urn:ngsi-ld:Person:p": '{"id":"urn:ngsi-ld:Person:p","type":"Person","nick":"p"}',
        "urn:ngsi-ld:Person:q": '{"id":"urn:ngsi-ld:Person:q","type":"Person","nick":"q"}',
    }
    series = {r.id: r.entity for r in M.run(df, m, "pos", "concise", "series").collect()}
    assert '"reading":[{"value":1.5,' in series["urn:ngsi-ld:Sensor:S-K"] and '"name":"a"' in series["urn:ngsi-ld:Sensor:S-K"]


def test_mapping_checks():
    m = json5.loads(MAPPING)
    for bad in ({**m, "x": 1}, {**m, "version": "v3"}, {**m, "attributes": {"id": {"source": "a"}}}, {**m, "attributes": {"a": {"source": "{{ x | foo"}}}, {**m, "identity": {"entityName": "a", "scope": "b"}}, {**m, "attributes": {"a": {"type": "Relationship", "source": "x"}}}, {**m, "attributes": {"a": {"type": "GeoProperty", "source": "x", "transformation": "integer"}}}):
        with pytest.raises(M.MappingError):
            M.check(bad)


def test_several_parts(spark):
    df = spark.createDataFrame([(1, "x", None, "", "[1, \"\"]"), (2, None, None, "", None), (3, "no", 4, "b", " ")], "pos int, a string, n int, b string, l string")
    attributes = {
        "flag": {"source": ["{{ n }}", "{{ a }}"], "transformation": "boolean"},
        "text": {"source": ["<", "{{ a }}", "{{ n }}", ">"], "transformation": "string"},
        "kept": {"source": ["{{ n }}", "{{ a }}"]},
        "items": {"source": ["{{ l }}", "{{ a }}", "{{ b }}"], "transformation": "array"},
        "at": {"type": "GeoProperty", "source": ["{{ n }}", "{{ n }}"], "transformation": "point"},
    }
    m = {"version": "v4", "dataModel": "T", "identity": {"entityName": "{{ pos }}"}, "attributes": attributes}
    got = {r.id[-1]: json.loads(r.entity) for r in M.run(df, m, "pos", "simplified").collect()}
    assert got["1"] == {"id": "urn:ngsi-ld:T:1", "type": "T", "text": "<x>", "kept": "x", "items": ["1", "x"]}
    assert got["2"] == {"id": "urn:ngsi-ld:T:2", "type": "T"}
    assert got["3"] == {"id": "urn:ngsi-ld:T:3", "type": "T", "flag": True, "text": "<no4>", "kept": [4, "no"], "items": ["no", "b"], "at": {"type": "Point", "coordinates": [4, 4]}}


def test_synthetic_per_token(spark):
    df = spark.createDataFrame([(1, "b a, b", "x"), (2, None, "y"), (3, "- c", "z")], "pos int, l string, v string")
    token = {"dataModel": "K", "identity": {"entityName": "{{ this[0] }}"}, "attributes": {"of": {"source": "{{ v }}"}, "name": {"source": "{{ this[0] }}"}}}
    m = {"version": "v4", "dataModel": "T", "identity": {"entityName": "{{ pos }}"}, "attributes": {"ks": {"type": "ListRelationship", "source": "{{ l }}", "syntheticEntity": token}}}
    got = {r.id.removeprefix("urn:ngsi-ld:"): json.loads(r.entity) for r in M.run(df, m, "pos", "normalized").collect()}
    assert set(got) == {"T:1", "T:2", "T:3", "K:a", "K:b", "K:c"}
    assert [got[f"T:{k}"].get("ks", {}).get("objectList") for k in (1, 2, 3)] == [["urn:ngsi-ld:K:b", "urn:ngsi-ld:K:a"], None, ["urn:ngsi-ld:K:c"]]
    assert (got["K:b"]["of"]["value"], got["K:b"]["name"]["value"], got["K:c"]["of"]["value"]) == ("x", "b", "z")
    with pytest.raises(M.MappingError):
        M.check({**m, "attributes": {"ks": {"type": "ListRelationship", "syntheticEntity": token}}})
