"""Hand-made feature tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from busnet import schemas
from busnet.sources.features import element_geometry

LAT = 45.0
M_LAT = 1 / 111131.7  # degrees per metre north at LAT
M_LON = 1 / 78846.8  # degrees per metre east at LAT


def at(east: float, north: float) -> tuple[float, float]:
    """(lon, lat) so many metres from (2, 45)."""
    return 2.0 + east * M_LON, LAT + north * M_LAT


@dataclass
class SmallFeatures:
    spark: SparkSession
    nodes: dict = field(default_factory=dict)  # osm_id -> (name, (lon, lat))
    stop_ways: dict = field(default_factory=dict)  # osm_id -> (name, [(lon, lat), ...])
    streets: dict = field(default_factory=dict)  # way_id -> [(lon, lat), ...]
    routes: list = field(default_factory=list)  # (osm_id, ref, colour)
    members: list = field(default_factory=list)  # (rel, index, role, type, osm_id)

    def _stops(self, rows) -> DataFrame:
        return self.spark.createDataFrame(
            [(i + 1, i, name, *[False] * 5, "", "bus_stop", "", geom) for i, name, geom in rows],
            schemas.BUS_STOP,
        )

    @property
    def nodes_bus_stop(self):
        return self._stops([(i, n, [p]) for i, (n, p) in self.nodes.items()])

    @property
    def ways_bus_stop(self):
        return self._stops([(i, n, g) for i, (n, g) in self.stop_ways.items()])

    @property
    def nodes_bus_station(self):
        return self.spark.createDataFrame([], schemas.BUS_STATION)

    ways_bus_station = nodes_bus_station

    @property
    def relations_route(self):
        return self.spark.createDataFrame(
            [(-i, f"R{i}", ref, "net", "a", "b", colour, "op", "2", "bus") for i, ref, colour in self.routes],
            schemas.RELATIONS_ROUTE,
        )

    @property
    def member_refs(self):
        return self.spark.createDataFrame(
            [(-r, o, i, role, t) for r, i, role, t, o in self.members],
            "rel_osm_id LONG, member_osm_id LONG, member_index INT, member_role STRING, member_type INT",
        )

    @property
    def element_geometry(self):
        lines = self.spark.createDataFrame(
            [(i, g) for i, g in self.streets.items()] + [(i, g) for i, (_, g) in self.stop_ways.items()],
            "way_id LONG, geom ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>",
        )
        return element_geometry(self.nodes_bus_stop, lines)
