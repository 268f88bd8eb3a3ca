"""OSM XML and Parquet element readers, end to end to the feature tables."""

import pytest
from pyspark.sql import functions as F

from busnet.functions.tags import bool_tag, load_tags
from busnet.plans.network import Network
from busnet.sources import osm

XML = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
  <node id="1" lat="45.0" lon="2.0"><tag k="highway" v="bus_stop"/><tag k="name" v="Mairie"/>
    <tag k="shelter" v="yes"/><tag k="bench" v="no"/><tag k="source" v="survey"/></node>
  <node id="2" lat="45.001" lon="2.0"/>
  <node id="3" lat="45.002" lon="2.0"/>
  <node id="4" lat="45.002" lon="2.001"><tag k="amenity" v="bus_station"/><tag k="name" v="Gare"/></node>
  <node id="5" lat="45.0" lon="2.001"/>
  <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>
  <way id="11"><nd ref="3"/><nd ref="2"/><tag k="highway" v="bus_stop"/></way>
  <way id="12"><nd ref="1"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="amenity" v="bus_station"/></way>
  <way id="13"><nd ref="1"/><nd ref="3"/><nd ref="4"/><tag k="amenity" v="bus_station"/></way>
  <relation id="100"><member type="node" ref="1" role="stop"/><member type="way" ref="10" role=""/>
    <member type="way" ref="11" role="platform"/><member type="relation" ref="7" role="stop"/>
    <member type="node" ref="99" role="stop"/>
    <tag k="type" v="route"/><tag k="route" v="bus"/><tag k="ref" v="8"/><tag k="from" v="A"/>
    <tag k="to" v="B"/><tag k="public_transport:version" v="2"/></relation>
  <relation id="101"><member type="node" ref="1" role="stop"/><tag k="type" v="route"/><tag k="route" v="tram"/></relation>
</osm>
"""


@pytest.fixture(scope="module", params=["xml", "parquet"])
def features(request, spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("osm")
    (root / "xml").mkdir()
    (root / "xml" / "a.osm").write_text(XML)
    elements = osm.read_xml(spark, str(root / "xml"))
    if request.param == "parquet":
        for name, df in zip(("node", "way", "relation"), elements):
            df.write.parquet(str(root / "tables" / name))
        elements = osm.read_parquet(spark, str(root / "tables"))
    return osm.OsmFeatures(*elements)


def test_node_stop(features):
    row = features.nodes_bus_stop.first()
    assert (row["osm_id"], row["name"], row["local_ref"]) == (1, "Mairie", "")
    assert (row["has_shelter"], row["has_bench"], row["is_wheelchair_ok"]) == (True, False, False)
    assert features.nodes_bus_stop.count() == 1


def test_way_stop_keeps_vertex_order(features):
    row = features.ways_bus_stop.first()
    assert row["osm_id"] == 11 and [p["lat"] for p in row["geom"]] == [45.002, 45.001]


def test_stations(features):
    assert [r["name"] for r in features.nodes_bus_station.collect()] == ["Gare"]
    rows = features.ways_bus_station.collect()  # the open way 13 is no area
    assert [(r["osm_id"], r["geom_type"]) for r in rows] == [(12, "ST_Polygon")]


def test_relations(features):
    rows = features.relations_route.collect()
    assert [(r["osm_id"], r["ref"], r["origin"], r["destination"], r["colour"], r["public_transport_version"],
             r["transport_mode"]) for r in rows] == [(-100, "8", "A", "B", "", "2", "bus")]


def test_members(features):
    net = Network(features)
    rows = net.members.orderBy("member_index").collect()
    assert [(r["member_index"], r["member_type"], r["member_osm_id"], r["member_role"]) for r in rows] == [
        (0, 0, 1, "stop"), (1, 1, 10, ""), (2, 1, 11, "platform"), (3, 2, 7, "stop"), (4, 0, 99, "stop"),
    ]
    assert [r["geom"] is None or len(r["geom"]) for r in rows] == [1, 3, 2, True, True]
    assert net.i_ways.count() == 1 and net.i_positions.count() == 3


def test_tags(spark):
    df = spark.createDataFrame(
        [([("created_by", "x"), ("bench", "false"), ("shelter", "1")],), (None,)],
        "tag array<struct<_k:string,_v:string>>",
    ).select(load_tags(F.col("tag")).alias("tags"))
    got = df.select("tags", bool_tag(F.col("tags"), "bench"), bool_tag(F.col("tags"), "shelter")).collect()
    assert [tuple(r) for r in got] == [({"bench": "false", "shelter": "1"}, False, True), ({}, False, False)]


def plain(df):
    return sorted(map(str, df.collect()))


TABLES = ["nodes_bus_stop", "ways_bus_stop", "nodes_bus_station", "ways_bus_station", "relations_route", "member_refs", "element_geometry"]


def test_overlapping_extracts_are_one(spark, tmp_path):
    """The same file twice, and an older and a deleted version beside it, give what one file gives."""
    newest = XML.replace('lat="45.001"', 'version="3" lat="45.001"').replace('<way id="10">', '<way id="10" version="2">')
    for folder, files in {"one": [newest], "three": [newest, newest, """<osm version="0.6">
      <node id="2" version="2" lat="44" lon="3"><tag k="highway" v="bus_stop"/></node>
      <node id="77" version="1" lat="45" lon="2"><tag k="highway" v="bus_stop"/></node>
      <way id="10" version="1"><nd ref="3"/><nd ref="1"/></way></osm>""", """<osm version="0.6">
      <node id="77" version="2" visible="false"/></osm>"""]}.items():
        (tmp_path / folder).mkdir()
        for i, text in enumerate(files):
            (tmp_path / folder / f"{i}.osm").write_text(text)
    one, three = (osm.OsmFeatures(*osm.read_xml(spark, str(tmp_path / f))) for f in ("one", "three"))
    for name in TABLES:
        assert plain(getattr(one, name)) == plain(getattr(three, name)), name
    assert len(one.element_geometry.filter("member_osm_id = 10").first()["geom"]) == 3


def square(first, west, south, size):
    corners = [(west, south), (west + size, south), (west + size, south + size), (west, south + size)]
    return [(first + i, lon, lat) for i, (lon, lat) in enumerate(corners)]


def test_stations_from_relations(spark):
    """Rings put together from open ways, a hole, two parts, parts that touch along an edge, and a ring that does not close."""
    nodes = square(1, 0.0, 0.0, 0.004) + square(5, 0.001, 0.001, 0.001) + square(9, 0.01, 0.0, 0.002)
    nodes += [(13, 0.014, 0.0), (14, 0.014, 0.002)]
    ways = {
        1: [1, 2, 3], 2: [1, 4, 3], 3: [5, 6], 4: [7, 6], 5: [8, 7], 6: [8, 5],
        7: [9, 10, 11, 12, 9], 8: [10, 13, 14, 11, 10], 9: [9, 10, 11],
    }
    tags = lambda name: {"type": "multipolygon", "amenity": "bus_station", "name": name}
    outer = lambda *ids: [("way", i, "outer") for i in ids]
    relations = [
        (50, outer(1, 2) + [("way", i, "inner") for i in (3, 4, 5, 6)], tags("hole")),
        (51, [("way", 7, "")] + outer(1, 2) + [("node", 1, "label")], tags("two")), (52, outer(9), tags("open")),
        (53, outer(7, 8), tags("joined")), (54, outer(1, 2), {"type": "multipolygon", "name": "no station"}),
    ]
    features = osm.OsmFeatures(
        spark.createDataFrame([(i, lat, lon, {}) for i, lon, lat in nodes], "id long, lat double, lon double, tags map<string,string>"),
        spark.createDataFrame([(i, n, {}) for i, n in ways.items()], "id long, nds array<long>, tags map<string,string>"),
        spark.createDataFrame(relations, "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"),
    )
    found = {r["name"]: r for r in features.ways_bus_station.collect()}
    assert sorted(found) == ["hole", "joined", "two"]
    shape = lambda r: (r["osm_id"], r["geom_type"], len(r["geom"]), [(x["hole"], len(x["geom"])) for x in r["rings"]])
    assert shape(found["hole"]) == (-50, "ST_Polygon", 5, [(True, 5)])
    assert shape(found["two"]) == (-51, "ST_MultiPolygon", 5, [(False, 5)])
    assert shape(found["joined"]) == (-53, "ST_Polygon", 7, [])
    net = Network(features)
    spots = {r["name"]: (r["lon"], r["lat"], r["has_polygon"]) for r in net.d_stations.collect()}
    # 16 squares round 0.002 less one round 0.0015; 16 round 0.002 with 4 round (0.011, 0.001); two halves
    assert spots["hole"] == (pytest.approx((16 * 0.002 - 0.0015) / 15, abs=1e-8), pytest.approx((16 * 0.002 - 0.0015) / 15, abs=1e-8), True)
    assert spots["two"] == (pytest.approx((16 * 0.002 + 4 * 0.011) / 20, abs=1e-8), pytest.approx((16 * 0.002 + 4 * 0.001) / 20, abs=1e-8), False)
    assert spots["joined"] == (pytest.approx(0.012, abs=1e-8), pytest.approx(0.001, abs=1e-8), True)
    assert {r["name"]: len(r["holes"]) for r in net.d_stations_area.collect()} == {"hole": 1, "joined": 0}
