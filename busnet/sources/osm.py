"""OSM elements (XML files or Parquet element tables) -> feature tables.

Several extracts may overlap: of an element that more than one of them holds the latest version counts, before any
reference to it is resolved.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from busnet import schemas
from busnet.functions.geo import point, segments
from busnet.functions.tags import NODE, RELATION, WAY, bool_tag, load_tags, string_tag
from busnet.operators import ranking
from busnet.session import cut_lineage, keep
from busnet.sources.features import assemble_lines, element_geometry

# The tags that are read.
_FLAG_TAGS = {
    "has_shelter": "shelter",
    "has_bench": "bench",
    "has_tactile_paving": "tactile_paving",
    "has_departures_board": "departures_board",
    "is_wheelchair_ok": "wheelchair",
}
_ROUTE_TAGS = {
    "name": "name",
    "ref": "ref",
    "network": "network",
    "origin": "from",
    "destination": "to",
    "colour": "colour",
    "operator": "operator",
    "public_transport_version": "public_transport:version",
    "transport_mode": "route",
}


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of every OSM XML file under path."""

    def rows(tag: str, schema) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    state = [F.col("_version").alias("version"), F.col("_visible").alias("visible")]
    nodes = rows("node", schemas.XML_NODE).select(
        F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
        load_tags(F.col("tag")).alias("tags"), *state,
    )
    ways = rows("way", schemas.XML_WAY).select(
        F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("nds"),
        load_tags(F.col("tag")).alias("tags"), *state,
    )
    relations = rows("relation", schemas.XML_RELATION).select(
        F.col("_id").alias("id"),
        F.transform(
            "member",
            lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")),
        ).alias("members"),
        load_tags(F.col("tag")).alias("tags"), *state,
    )
    return nodes, ways, relations


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) from element tables path/{node,way,relation}."""
    return (
        spark.read.schema(schemas.OSM_NODE).parquet(f"{path}/node"),
        spark.read.schema(schemas.OSM_WAY).parquet(f"{path}/way"),
        spark.read.schema(schemas.OSM_RELATION).parquet(f"{path}/relation"),
    )


def latest(elements: DataFrame) -> DataFrame:
    """One row per id: that of the greatest version, none if it says the element is gone (visible is false).

    Elements without a version are older than all others; of equal versions one row is taken whole, by its content.
    """
    if "version" not in elements.columns:
        elements = elements.withColumn("version", F.lit(None).cast("long")).withColumn("visible", F.lit(None).cast("boolean"))
    body = [c for c in elements.columns if c not in ("id", "version")]
    content = F.xxhash64(*[F.array_sort(F.map_entries("tags")) if c == "tags" else F.col(c) for c in body])
    order = F.struct(F.coalesce("version", F.lit(-1)).alias("version"), content.alias("content"))
    one = elements.groupBy("id").agg(F.max_by(F.struct(*body), order).alias("e")).select("id", "e.*")
    return one.filter(F.coalesce("visible", F.lit(True))).drop("visible")


def way_vertices(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node references resolved to (way_id, pos, lon, lat); unknown nodes are left out."""
    refs = ways.select(F.col("id").alias("way_id"), F.posexplode("nds").alias("pos", "node_id"))
    at = nodes.select(F.col("id").alias("node_id"), "lon", "lat")
    return refs.join(at, "node_id").select("way_id", "pos", "lon", "lat")


def _stop_columns(tags: Column) -> list[Column]:
    return [
        string_tag(tags, "name").alias("name"),
        *[bool_tag(tags, tag).alias(column) for column, tag in _FLAG_TAGS.items()],
        string_tag(tags, "local_ref").alias("local_ref"),
        string_tag(tags, "highway").alias("highway"),
        string_tag(tags, "public_transport").alias("public_transport"),
    ]


def _surrogate(osm_id: Column) -> Column:
    return F.xxhash64(osm_id).alias("id")


def _has(key: str, value: str) -> Column:
    return F.element_at(F.col("tags"), F.lit(key)) == value


def nodes_bus_stop(nodes: DataFrame) -> DataFrame:
    return nodes.filter(_has("highway", "bus_stop")).select(
        _surrogate(F.col("id")), F.col("id").alias("osm_id"), *_stop_columns(F.col("tags")),
        F.array(point(F.col("lon"), F.col("lat"))).alias("geom"),
    )


def ways_bus_stop(ways: DataFrame, lines: DataFrame) -> DataFrame:
    return ways.filter(_has("highway", "bus_stop")).join(lines, ways["id"] == lines["way_id"]).select(
        _surrogate(ways["id"]), ways["id"].alias("osm_id"), *_stop_columns(F.col("tags")), "geom"
    )


def _no_rings() -> Column:
    return F.array().cast(schemas.BUS_STATION["rings"].dataType).alias("rings")


def nodes_bus_station(nodes: DataFrame) -> DataFrame:
    return nodes.filter(_has("amenity", "bus_station")).select(
        _surrogate(F.col("id")), F.col("id").alias("osm_id"),
        string_tag(F.col("tags"), "name").alias("name"), F.lit("ST_Point").alias("geom_type"),
        F.array(point(F.col("lon"), F.col("lat"))).alias("geom"), _no_rings(),
    )


def ways_bus_station(ways: DataFrame, lines: DataFrame) -> DataFrame:
    """Closed rings only (first vertex repeated last, four vertices or more)."""
    closed = (F.size("geom") >= 4) & (F.col("geom")[0] == F.element_at("geom", -1))
    return (
        ways.filter(_has("amenity", "bus_station"))
        .join(lines, ways["id"] == lines["way_id"])
        .filter(closed)
        .select(
            _surrogate(ways["id"]), ways["id"].alias("osm_id"),
            string_tag(F.col("tags"), "name").alias("name"),
            F.lit("ST_Polygon").alias("geom_type"), "geom", _no_rings(),
        )
    )


def station_relations(relations: DataFrame) -> DataFrame:
    return relations.filter(_has("type", "multipolygon") & _has("amenity", "bus_station"))


def ring_members(relations: DataFrame) -> DataFrame:
    """(rel, hole, way_id) of the rings of station relations; an empty role is that of an outer ring."""
    return (
        station_relations(relations).select(F.col("id").alias("rel"), F.explode("members").alias("m"))
        .filter((F.col("m.type") == "way") & F.coalesce("m.role", F.lit("")).isin("", "outer", "inner"))
        .select("rel", (F.coalesce("m.role", F.lit("")) == "inner").alias("hole"), F.col("m.ref").alias("way_id"))
        .distinct()
    )


def closed_rings(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(rel, hole, geom): closed rings put together from the members' lines, end to end.

    An edge drawn twice on one side (rings that touch along it) cancels out; lines that do not close are dropped.
    """
    side = ["rel", "hole"]
    pair = members.join(lines, "way_id").select(*side, F.explode(segments(F.col("geom"))).alias("s")).filter("s.a != s.b")
    edges = (
        pair.groupBy(*side, F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b"))
        .agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")
    )
    paths = ranking.ranked(cut_lineage(edges), side).groupBy(*side, "line").agg(
        F.array_sort(F.collect_list(F.struct(F.negative("d").alias("d"), "u"))).alias("path"), F.min(F.struct("d", "v")).alias("last")
    )
    geom = F.concat(F.transform("path", lambda p: p["u"]), F.array("last.v"))
    return paths.select(*side, geom.alias("geom")).filter((F.size("geom") >= 4) & (F.col("geom")[0] == F.element_at("geom", -1)))


def relations_bus_station(relations: DataFrame, rings: DataFrame) -> DataFrame:
    """Stations that are multipolygon relations with at least one closed outer ring."""
    ring = F.struct("hole", "geom")
    # outer rings first
    areas = rings.groupBy("rel").agg(
        F.array_sort(F.collect_list(ring)).alias("all"), F.count_if(~F.col("hole")).alias("parts")
    ).filter("parts > 0")
    found = station_relations(relations)
    return found.join(areas, found["id"] == areas["rel"]).select(
        _surrogate(-F.col("id")), (-F.col("id")).alias("osm_id"), string_tag(F.col("tags"), "name").alias("name"),
        F.when(F.col("parts") == 1, "ST_Polygon").otherwise("ST_MultiPolygon").alias("geom_type"),
        F.col("all")[0]["geom"].alias("geom"), F.slice("all", 2, F.size("all")).alias("rings"),
    )


def bus_relations(relations: DataFrame) -> DataFrame:
    return relations.filter(_has("type", "route") & _has("route", "bus"))


def relations_route(relations: DataFrame) -> DataFrame:
    return bus_relations(relations).select(
        (-F.col("id")).alias("osm_id"),
        *[string_tag(F.col("tags"), tag).alias(column) for column, tag in _ROUTE_TAGS.items()],
    )


def member_refs(relations: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("m.type") == "node", F.lit(NODE))
        .when(F.col("m.type") == "way", F.lit(WAY))
        .when(F.col("m.type") == "relation", F.lit(RELATION))
    )
    return (
        bus_relations(relations)
        .select((-F.col("id")).alias("rel_osm_id"), F.posexplode("members").alias("member_index", "m"))
        .select(
            "rel_osm_id", F.col("m.ref").alias("member_osm_id"), "member_index",
            F.col("m.role").alias("member_role"), kind.alias("member_type"),
        )
    )


class OsmFeatures:
    """Feature tables of one or several extracts; geometry is assembled only for ways that some table needs.

    The merged elements are written once, so that files are parsed once, whatever is built from them.
    """

    def __init__(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame):
        self._nodes, self._ways, self._relations = (
            keep(latest(df), f"osm-{name}") for name, df in (("nodes", nodes), ("ways", ways), ("relations", relations))
        )

    @cached_property
    def _lines(self) -> DataFrame:
        featured = self._ways.filter(_has("highway", "bus_stop") | _has("amenity", "bus_station"))
        wanted = (
            self.member_refs.filter(F.col("member_type") == WAY)
            .select(F.col("member_osm_id").alias("id"))
            .unionByName(featured.select("id"))
            .unionByName(ring_members(self._relations).select(F.col("way_id").alias("id")))
        )
        return assemble_lines(
            way_vertices(self._ways.join(wanted, "id", "left_semi"), self._nodes)
        )

    @cached_property
    def nodes_bus_stop(self) -> DataFrame:
        return nodes_bus_stop(self._nodes)

    @cached_property
    def ways_bus_stop(self) -> DataFrame:
        return ways_bus_stop(self._ways, self._lines)

    @cached_property
    def nodes_bus_station(self) -> DataFrame:
        return nodes_bus_station(self._nodes)

    @cached_property
    def ways_bus_station(self) -> DataFrame:
        """Closed ways and multipolygon relations (with negative ids)."""
        rings = cut_lineage(closed_rings(ring_members(self._relations), self._lines))
        return ways_bus_station(self._ways, self._lines).unionByName(relations_bus_station(self._relations, rings))

    @cached_property
    def relations_route(self) -> DataFrame:
        return relations_route(self._relations)

    @cached_property
    def member_refs(self) -> DataFrame:
        return member_refs(self._relations)

    @cached_property
    def element_geometry(self) -> DataFrame:
        """Geometry of route members only."""
        wanted = self.member_refs.filter(F.col("member_type") == NODE).select(
            F.col("member_osm_id").alias("id")
        )
        points = self._nodes.join(wanted, "id", "left_semi").select(
            F.col("id").alias("osm_id"), F.array(point(F.col("lon"), F.col("lat"))).alias("geom")
        )
        return element_geometry(points, self._lines)
