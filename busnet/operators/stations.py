"""Bus stations: points and areas.

An area is its first outer ring (geom) and further ones (rings: hole, geom).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from busnet.functions import geo
from busnet.functions.tags import NODE, WAY
from busnet.operators.routes import with_centroid


def stations_union(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """i_stations: node and way stations under one type tag, duplicates removed."""
    return (
        nodes.withColumn("osm_type", F.lit(NODE))
        .unionByName(ways.withColumn("osm_type", F.lit(WAY)))
        .distinct()
    )


def stations(all_stations: DataFrame) -> DataFrame:
    """d_stations: name, whether the station is drawn as a (simple) polygon, centroid."""
    is_area = F.col("geom_type").isin("ST_Polygon", "ST_MultiPolygon")
    centroid = F.when(is_area, geo.rings_centroid(F.col("geom"), F.col("rings"))).otherwise(
        geo.line_centroid(F.col("geom"))
    )
    return with_centroid(all_stations, centroid).select(
        "osm_type", "osm_id", "name", (F.col("geom_type") == "ST_Polygon").alias("has_polygon"),
        "x", "y", "lon", "lat",
    )


def station_areas(all_stations: DataFrame) -> DataFrame:
    """d_stations_area: polygons of one part, with their holes."""
    return all_stations.filter(F.col("geom_type") == "ST_Polygon").select(
        "osm_type", "osm_id", "name", "geom", F.transform("rings", lambda r: r["geom"]).alias("holes")
    )
