"""One document per route and per stop, in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busnet.functions import geo
from busnet.functions.tags import (
    default_if_blank, element_code, element_word, member_label, sort_nulls_last,
)
from busnet.operators.connections import shield_text, shields_of_text
from busnet.operators.routes import ROUTE_COLUMNS

ATTRIBUTION = "<a href='https://www.openstreetmap.org/copyright/'>© OpenStreetMap contributors</a>"

# what the map shows in place of a missing text (fixed values)
UNKNOWN_TEXT = "??"
UNKNOWN_COLOUR = "grey"
UNNAMED_STOP = "pas de nom :("

# keys of a stop's document (fixed values)
STOP_PROPERTIES = [
    "osm_type", "osm_id", "name", "local_ref", "has_shelter", "has_bench",
    "has_tactile_paving", "has_departures_board", "is_wheelchair_ok",
]


def to_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def route_properties(paths: DataFrame, route_id: int | None = None) -> DataFrame:
    rows = paths if route_id is None else paths.filter(F.col("osm_id") == route_id)
    return rows.select(*ROUTE_COLUMNS)


def geometry_collection(lines: Column) -> Column:
    """Ordered lines as one GeoJSON collection; NULL stays NULL."""
    return F.when(
        lines.isNotNull(),
        F.struct(
            F.lit("GeometryCollection").alias("type"),
            F.transform(lines, geo.geojson_line).alias("geometries"),
        ),
    )


def route_geometry(paths: DataFrame) -> DataFrame:
    """(osm_id, geometry): GeoJSON text of the path, NULL without one."""
    return paths.select("osm_id", to_json(geometry_collection(F.col("geom"))).alias("geometry"))


def stop_position_list(rows: DataFrame) -> DataFrame:
    """(route_osm_id, positions): a route's projected points ordered by id."""
    at = F.struct("pos", geo.lon_of(F.col("x")).alias("lon"), geo.lat_of(F.col("y")).alias("lat"))
    return rows.repartition("route_osm_id").groupBy("route_osm_id").agg(F.sort_array(F.collect_list(at)).alias("positions"))


def stop_list(connections: DataFrame) -> DataFrame:
    """(route_osm_id, stops): a route's stops in order, each with its shields: ref and colour of the other routes, blank
    refs removed.

    The list of a hot stop goes to each of its routes, so it travels as text (`shields`, made of the list if not there).
    """
    if "shields" not in connections.columns:
        connections = connections.withColumn("shields", shield_text(F.col("other_routes_at_stop")))
    entry = F.struct(
        "stop_index", "stop_osm_type", "stop_osm_id",
        F.col("stop_name").alias("name"), "lon", "lat",
        "shields",
        member_label(F.col("stop_osm_type"), F.col("stop_osm_id")).alias("osm_id"),
    )
    ordered = F.sort_array(F.collect_list(entry))
    return connections.groupBy("route_osm_id").agg(
        F.transform(
            ordered,
            lambda s: F.struct(
                *[s[c].alias(c) for c in ("name", "lon", "lat")], shields_of_text(s["shields"]).alias("shields"), s["osm_id"].alias("osm_id")
            ),
        ).alias("stops")
    )


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def route_documents(
    paths: DataFrame, stop_positions: DataFrame, connections: DataFrame, attribution: str = ATTRIBUTION
) -> DataFrame:
    """(osm_id, route_info, stop_positions, stop_list, geometry, attribution), one row per route."""
    points = stop_position_list(stop_positions).withColumnRenamed("route_osm_id", "osm_id")
    listed = stop_list(connections).withColumnRenamed("route_osm_id", "osm_id")
    found = F.transform("positions", lambda p: geo.geojson_point(p["lon"], p["lat"]))
    point_type = "array<struct<type:string,coordinates:array<double>>>"
    stop_type = (
        "array<struct<name:string,lon:double,lat:double,"
        "shields:array<struct<ref:string,colour:string>>,osm_id:string>>"
    )
    return (
        paths.join(points, "osm_id", "left")
        .join(listed, "osm_id", "left")
        .select(
            "osm_id",
            F.struct(*ROUTE_COLUMNS).alias("route_info"),
            F.struct(
                F.lit("GeometryCollection").alias("type"),
                F.coalesce(found, _empty(point_type)).alias("geometries"),
            ).alias("stop_positions"),
            F.coalesce("stops", _empty(stop_type)).alias("stop_list"),
            geometry_collection(F.col("geom")).alias("geometry"),
            F.lit(attribution).alias("attribution"),
        )
    )


def stop_attributes(stops: DataFrame, osm_id: int | None = None, osm_type: str | None = None) -> DataFrame:
    """The properties and GeoJSON of stops; with an id, of the one stop of that element word."""
    rows = stops
    if osm_id is not None:
        rows = rows.filter((F.col("osm_id") == osm_id) & (F.col("osm_type") == element_code(osm_type)))
    return rows.select(
        *STOP_PROPERTIES, geo.geojson_point(F.col("lon"), F.col("lat")).alias("geometry")
    )


def routes_list(at_stop: DataFrame) -> DataFrame:
    """(osm_type, osm_id, routes_at_stop): visits ordered by ref, NULL refs last, ties by route."""
    entry = F.struct(
        F.col("rel_osm_id").alias("route_osm_id"),
        *[F.col(f"rel_{c}").alias(c) for c in ("ref", "name", "network", "operator")],
        "transport_mode",
        *[F.col(f"rel_{c}").alias(c) for c in ("origin", "destination", "colour")],
    )
    return at_stop.groupBy("osm_type", "osm_id").agg(
        sort_nulls_last(F.collect_list(entry), "ref", "route_osm_id").alias("routes_at_stop")
    )


def stop_documents(stops: DataFrame, at_stop: DataFrame) -> DataFrame:
    """(osm_type, osm_id, type, geometry, properties): a GeoJSON Feature per stop."""
    served = routes_list(at_stop)
    rows = stop_attributes(stops).join(served, ["osm_type", "osm_id"], "left")
    none = _empty(served.schema["routes_at_stop"].dataType.simpleString())
    plain = [c for c in STOP_PROPERTIES if c != "osm_type"]
    return rows.select(
        "osm_type", "osm_id", F.lit("Feature").alias("type"), "geometry",
        F.struct(
            element_word(F.col("osm_type")).alias("osm_type"), *plain,
            F.coalesce("routes_at_stop", none).alias("routes_at_stop"),
        ).alias("properties"),
    )


def route_display(routes: DataFrame) -> DataFrame:
    """What the map shows for a route."""
    texts = ["name", "ref", "network", "origin", "destination", "operator"]
    return routes.select(
        "osm_id", *[default_if_blank(F.col(c), UNKNOWN_TEXT).alias(c) for c in texts],
        default_if_blank(F.col("colour"), UNKNOWN_COLOUR).alias("colour"),
    )


def stop_badges(stops: DataFrame) -> DataFrame:
    """The shown name and amenity badges of a stop."""
    shelter, bench = F.col("has_shelter"), F.col("has_bench")
    place = (
        F.when(shelter & bench, F.lit("shelter_bench"))
        .when(shelter, F.lit("shelter"))
        .when(bench, F.lit("bench"))
    )
    badges = F.array_compact(
        F.array(
            place,
            F.when(F.col("has_departures_board"), F.lit("departures")),
            F.when(F.col("is_wheelchair_ok"), F.lit("wheelchair")),
            F.when(F.col("has_tactile_paving"), F.lit("tactile")),
        )
    )
    return stops.select(
        "osm_type", "osm_id", default_if_blank(F.col("name"), UNNAMED_STOP).alias("name"),
        badges.alias("badges"),
    )
