from __future__ import annotations

import json
from datetime import datetime

import pytest

from tesselite.plans import manifest
from tesselite.sources import sensorthings as S

LINES = [
    {"sensorthingsSnapshot": 1, "serviceRoot": "http://h/v1.1", "version": "1.1", "read": "range"},
    {"datastream": {"@iot.id": 1, "name": "t", "unitOfMeasurement": {"symbol": "C"}, "Thing": {"@iot.id": 9, "name": "Mast", "Locations": [{"@iot.id": 12, "encodingType": "application/geo+json", "location": {"type": "Point", "coordinates": [1, 2]}}, {"@iot.id": 3, "encodingType": "application/geo+json", "location": {"type": "Point", "coordinates": [3, 4]}}]}, "ObservedProperty": {"name": "temp"}, "Observations": [{"phenomenonTime": "2024-01-01T00:00:00Z", "result": 5}, {"phenomenonTime": "2024-01-02T00:00:00Z", "result": 6}]}},
    {"datastream": {"@iot.id": 2, "name": "u", "unitOfMeasurement": {"symbol": "C"}, "Thing": {"@iot.id": 9, "name": "Mast"}, "ObservedProperty": {"name": "temp"}, "Observations": []}},
    {"multiDatastream": {"@iot.id": 1, "Thing": {"@iot.id": 9, "name": "Mast"}, "ObservedProperties": [{"name": "u"}, {"name": "v"}], "unitOfMeasurements": [{"symbol": "m/s"}, {"symbol": "m/s"}]}},
    {"observation": {"@iot.id": 100, "phenomenonTime": "2024-01-01T00:00:00Z/2024-01-01T01:00:00Z", "result": 7.5}, "datastream": 2},
    {"observation": {"@iot.id": 101, "phenomenonTime": "2024-01-01T02:00:00Z", "result": [1, 2]}, "multiDatastream": 1},
]


def test_snapshot(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, LINES)))
    lines = S.read_lines(spark, str(tmp_path / "s.jsonl"))
    assert [r.kind for r in lines.collect()] == ["header", "datastream", "datastream", "multiDatastream", "observation", "observation"]
    got = sorted((r.observation, r.key, r.value.toPython(), r.at) for r in S.observations(lines).collect())
    assert got == [("100", "temp@2", 7.5, datetime(2024, 1, 1, 1)), ("101", "u", 1, datetime(2024, 1, 1, 2)), ("101", "v", 2, datetime(2024, 1, 1, 2))]
    (thing,) = S.latest(lines).collect()
    assert (thing.name, {k: v.value for k, v in thing.readings.items()}) == ("Mast", {"temp": "6"})
    assert json.loads(S.locations(lines).first().geometry)["coordinates"] == [3, 4]
    url = S.observations_request("http://h/v1.1/", "7", datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert url == "http://h/v1.1/Datastreams(7)/Observations?$filter=phenomenonTime+ge+2024-01-01T00:00:00Z+and+phenomenonTime+lt+2024-01-02T00:00:00Z&$orderby=phenomenonTime+asc,id+asc&$top=1000"
    assert S.same_origin("http://h/v1", "http://h/next") and not S.same_origin("http://h/v1", "http://evil/next")


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,v\nK,a,1\nK,b,2\nL,c,x\n")
    (tmp_path / "b.json").write_text('[{"id": "K", "note": "n"}, {"id": "M", "note": "m"}]')
    (tmp_path / "a.json5").write_text("{version: 'v4', dataModel: 'T', identity: {entityName: '{{ id }}'}, attributes: {name: {source: '{{ name }}'}, v: {source: '{{ v }}', transformation: 'integer'}}}")
    (tmp_path / "b.json5").write_text("{version: 'v4', dataModel: 'T', identity: {entityName: '{{ id }}'}, attributes: {note: {source: '{{ note }}'}, name: {source: 'late'}}}")
    m = manifest.check({"version": "v1", "inputs": [{"source": "a.csv", "mapping": "a.json5"}, {"source": "b.json", "mapping": "b.json5"}], "output": {"representation": "simplified"}})
    found = manifest.run(spark, m, str(tmp_path))
    got = {r.id[-1]: json.loads(r.entity) for r in found.collect()}
    assert got["K"] == {"id": "urn:ngsi-ld:T:K", "type": "T", "name": "a", "v": 1, "note": "n"}
    assert got["L"] == {"id": "urn:ngsi-ld:T:L", "type": "T", "name": "c"}
    assert got["M"] == {"id": "urn:ngsi-ld:T:M", "type": "T", "note": "m", "name": "late"}
    bad = manifest.deliver(found, {"directory": str(tmp_path / "out"), "framing": "line-delimited"}, {"required": ["v"]})
    assert {r.id[-1] for r in bad.collect()} == {"L", "M"}
    assert [json.loads(r.value)["v"] for r in spark.read.text(str(tmp_path / "out/type=T")).collect()] == [1]
    assert manifest.environment("a${X}b", {"X": "1"}) == "a1b"
    for broken in ({"version": "v1"}, {"version": "v2", "inputs": [{}]}, {"version": "v1", "inputs": [{"source": "a"}]}, {"version": "v1", "inputs": [], "x": 1}):
        with pytest.raises(manifest.ManifestError):
            manifest.check(broken)
    with pytest.raises(manifest.ManifestError):
        manifest.environment("${NOT_SET}", {})
