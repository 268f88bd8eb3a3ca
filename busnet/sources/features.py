"""The feature tables, and how way vertices and member geometry are assembled."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from busnet.functions.geo import point
from busnet.functions.tags import NODE, WAY


class FeatureTables(Protocol):
    """Inputs of every derivation; implementations build each table on first use.

    `member_refs` is `relation_members_route` without geometry: derivations that need no member
    geometry read it and skip the geometry join.  `element_geometry` is (member_type,
    member_osm_id, geom).
    """

    nodes_bus_stop: DataFrame
    ways_bus_stop: DataFrame
    nodes_bus_station: DataFrame
    ways_bus_station: DataFrame
    relations_route: DataFrame
    member_refs: DataFrame
    element_geometry: DataFrame


def assemble_lines(vertices: DataFrame) -> DataFrame:
    """(way_id, pos, lon, lat) -> (way_id, geom) in vertex order.

    An OSM way has at most 2000 vertices, which bounds the collected array.
    """
    return (
        vertices.groupBy("way_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("v"))
        .select("way_id", F.transform("v", lambda p: point(p["lon"], p["lat"])).alias("geom"))
    )


def element_geometry(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Node points (osm_id, geom) and way lines (way_id, geom) under one (type, id) key."""
    return nodes.select(
        F.lit(NODE).alias("member_type"), F.col("osm_id").alias("member_osm_id"), "geom"
    ).unionByName(
        lines.select(F.lit(WAY).alias("member_type"), F.col("way_id").alias("member_osm_id"), "geom")
    )


def attach_member_geometry(refs: DataFrame, geometry: DataFrame) -> DataFrame:
    """Members keep a NULL geometry when they are relations or not in the extract."""
    return refs.join(geometry, ["member_type", "member_osm_id"], "left")


def positive_route_ids(df: DataFrame, column: str) -> DataFrame:
    """Stored relation ids are negative; every derivation uses their absolute value."""
    return df.withColumn(column, F.abs(F.col(column)))
