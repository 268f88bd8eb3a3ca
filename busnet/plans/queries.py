"""The registered queries: each derivation over the whole given tables, in comparable columns.

Nested values become text and doubles are rounded, so any engine can check the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from busnet.functions import geo
from busnet.functions.tags import NODE, WAY
from busnet.operators import connections, documents, positions, publication, ranking, routes, stops, tiles
from busnet.plans.network import Network
from busnet.schemas import STOP_FLAGS
from busnet.session import configure, keep
from busnet.sources import fixture
from busnet.sources.features import attach_member_geometry

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Callable[[Network], DataFrame]] = {}


def _query(fn: Callable[[Network], DataFrame]) -> Callable[[Network], DataFrame]:
    _REGISTRY[fn.__name__] = fn
    return fn


#: Positions whose documents are made at a time; their stop lists shuffle some 1.5 GB.
_SHARE = 1 << 24


def network(spark: SparkSession, sf_dir: str, stored: tuple[str, ...] = ()) -> Network:
    """The network of the given tables; those named in `stored` are written once and read back."""
    return Network(
        fixture.FixtureFeatures(configure(spark), sf_dir),
        lambda name, df: keep(df, name, release=True) if name in stored else df,
        _SHARE if "t_route_documents" in stored else None,
    )


_SPOTS = ("t_members", "i_positions")
_FEET = (*_SPOTS, "t_best_projection")
_SHIELDS = ("t_stop_visits", "t_stop_texts")
_STREETS = ("t_member_refs", "t_element_geometry", "t_way_sets")

#: Tables that several steps of a query read.
_STORED: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("stop_projection", "stop_projection_metres", "best_projection", "route_position_points", "tile_positions"), _SPOTS),
    **dict.fromkeys(("positions_by_route", "route_stop_positions", "route_position_list"), _FEET),
    "route_document": (*_FEET, "d_route_stop_positions", *_SHIELDS, "t_route_documents"),
    "route_stop_list": _SHIELDS,
    **dict.fromkeys(("segments_merged", "segment_vertices", "tile_ways_z11", "tile_ways_z12"), _STREETS),
    "segments_by_route": (*_STREETS, "t_way_routes"),
    **dict.fromkeys(("stop_clusters", "stop_cluster_members"), ("t_cluster_members",)),
    **dict.fromkeys(("cluster_stats", "tile_stops_z11_13"), ("t_member_refs", "t_cluster_members")),
}


# integers that may be NULL are compared as doubles
NULLABLE = ["diameter", "avg_distance", "max_diameter", "max_avg_distance", "number_of_routes"]


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in NULLABLE else F.col(c) for c in df.columns])


def queries() -> dict[str, Query]:
    def run(fn: Callable[[Network], DataFrame]) -> Query:
        return lambda spark, sf_dir: _plain(fn(network(spark, sf_dir, _STORED.get(fn.__name__, ()))))

    return {name: run(fn) for name, fn in _REGISTRY.items()}


# --- text forms ---------------------------------------------------------------

def _e7(v: Column) -> Column:
    return F.round(v * F.lit(1e7)).cast("long").cast("string")


def _spot(lon: Column, lat: Column) -> Column:
    return F.concat(_e7(lon), F.lit(" "), _e7(lat))


def _line(geom: Column) -> Column:
    return F.array_join(F.transform(geom, lambda p: _spot(p["lon"], p["lat"])), ",")


def _txt(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit("\\N"))


def _fields(e: Column, *names: str) -> Column:
    parts = [p for n in names for p in (F.lit("|"), _txt(e[n]))]
    return F.concat(*parts[1:])


def _list(items: Column, *names: str) -> Column:
    return F.array_join(F.transform(items, lambda e: _fields(e, *names)), ";")


def _r3(*names: str) -> list[Column]:
    return [F.round(n, 3).alias(n) for n in names]


def _pairs() -> Column:
    return _list(F.col("routes_ref_colour"), "ref", "colour").alias("routes_ref_colour")


_STATS = ["max_diameter", "max_avg_distance", "number_of_routes"]
_TILE = ["z", "x_tile", "y_tile", "rank"]


# --- extraction ---------------------------------------------------------------

@_query
def feat_bus_stops(n: Network) -> DataFrame:
    f = n.features
    return (
        f.nodes_bus_stop.withColumn("osm_type", F.lit(NODE))
        .unionByName(f.ways_bus_stop.withColumn("osm_type", F.lit(WAY)))
        .select("osm_type", "osm_id", "name", *STOP_FLAGS, "local_ref", "highway", "public_transport",
                _line(F.col("geom")).alias("geom"))
    )


@_query
def feat_bus_stations(n: Network) -> DataFrame:
    f = n.features
    return (
        f.nodes_bus_station.withColumn("osm_type", F.lit(NODE))
        .unionByName(f.ways_bus_station.withColumn("osm_type", F.lit(WAY)))
        .select("osm_type", "osm_id", "name", "geom_type", _line(F.col("geom")).alias("geom"))
    )


@_query
def feat_routes(n: Network) -> DataFrame:
    return n.features.relations_route


@_query
def feat_route_members(n: Network) -> DataFrame:
    return attach_member_geometry(n.features.member_refs, n.features.element_geometry).select(
        "rel_osm_id", "member_osm_id", "member_index", "member_role", "member_type",
        _line(F.col("geom")).alias("geom"),
    )


@_query
def way_lines(n: Network) -> DataFrame:
    return n.element_geometry.filter(F.col("member_type") == WAY).select(
        F.col("member_osm_id").alias("way_id"), _line(F.col("geom")).alias("geom")
    )


@_query
def route_ids_abs(n: Network) -> DataFrame:
    return n.relations.select("osm_id", "name")


# --- internal tables ------------------------------------------------------------

@_query
def stop_role_members(n: Network) -> DataFrame:
    return n.member_refs.filter(routes.is_stop_role(F.col("member_role"))).select(
        "rel_osm_id", "member_index", "member_role"
    )


@_query
def stop_spacing(n: Network) -> DataFrame:
    return routes.stop_spacing(n.members).select("rel_osm_id", "member_index", *_r3("distance"))


@_query
def route_avg_distance(n: Network) -> DataFrame:
    return routes.route_statistics(n.members).select("rel_osm_id", "avg_distance")


@_query
def route_diameter(n: Network) -> DataFrame:
    return routes.route_statistics(n.members).select("rel_osm_id", "diameter")


@_query
def routes_internal(n: Network) -> DataFrame:
    return n.i_routes


@_query
def stops_union(n: Network) -> DataFrame:
    return n.i_stops.select("osm_type", "osm_id", "id", "name", *STOP_FLAGS, "local_ref", *_r3("x", "y"))


@_query
def stop_cluster_members(n: Network) -> DataFrame:
    first = F.min(F.struct("osm_type", "osm_id"))
    members = n.cluster_members
    label = members.groupBy("cluster_id").agg(first.alias("f")).select(
        "cluster_id", stops.element_label(F.col("f.osm_type"), F.col("f.osm_id")).alias("cluster_key")
    )
    return members.join(label, "cluster_id").select("osm_type", "osm_id", "name", "cluster_key")


@_query
def stop_clusters(n: Network) -> DataFrame:
    return n.i_stops_cluster.select(
        F.array_join("osm_type_id", ",").alias("osm_type_id"), "name",
        F.size("osm_id").alias("n_stops"), *_r3("x", "y"),
    )


@_query
def stations_union(n: Network) -> DataFrame:
    return n.i_stations.select("osm_type", "osm_id", "name", "geom_type", _line(F.col("geom")).alias("geom"))


@_query
def route_ways(n: Network) -> DataFrame:
    return n.i_ways.select("rel_osm_id", "index", _line(F.col("geom")).alias("geom"))


@_query
def route_positions(n: Network) -> DataFrame:
    return n.i_positions.select("rel_osm_id", "member_type", "member_osm_id", "member_index", *_r3("x", "y"))


# --- display tables -------------------------------------------------------------

@_query
def route_paths(n: Network) -> DataFrame:
    return n.d_routes.select(
        *routes.ROUTE_COLUMNS, F.array_join(F.transform("geom", _line), ";").alias("geom")
    )


@_query
def segment_route_sets(n: Network) -> DataFrame:
    from busnet.operators.segments import segment_route_sets as rows

    return rows(n.way_routes, n.way_shapes).select(
        _line(F.col("geom")).alias("geom"), "max_diameter", "number_of_routes", "rel_osm_id"
    )


def _low(field: str) -> Column:
    return F.array_min("geom")[field].alias(f"low_{field}")


@_query
def segments_merged(n: Network) -> DataFrame:
    return n.segments.select(
        "max_diameter", "number_of_routes", "n_edges", *_r3("length"), _low("lon"), _low("lat"),
        F.size("geom").alias("n_vertices"), F.array_join(F.transform("geom", lambda v: _nano(v["lon"], v["lat"])), ",").alias("vertices"),
    )


def _nano(lon: Column, lat: Column) -> Column:
    """A vertex in whole 1e-9 degrees, to which crossings are rounded."""
    return F.concat_ws(" ", *[F.round(v * F.lit(1e9)).cast("long").cast("string") for v in (lon, lat)])


@_query
def segment_vertices(n: Network) -> DataFrame:
    """The vertices of all streets in row form."""
    rows = ranking.vertices(n.street_lines, ["set_a", "set_b"])
    return rows.select(F.col("pos").cast("int").alias("pos"), _nano(F.col("lon"), F.col("lat")).alias("spot"))


@_query
def segments_by_route(n: Network) -> DataFrame:
    low = n.segments.select("id", F.array_min("geom").alias("low"))
    rows = n.route_segments.join(low, "id")
    spots = F.transform(F.sort_array(F.collect_list("low")), lambda p: _spot(p["lon"], p["lat"]))
    return rows.groupBy("rel_osm_id").agg(
        F.count("*").cast("int").alias("n_segments"), F.array_join(spots, ",").alias("segments")
    )


@_query
def stop_projection(n: Network) -> DataFrame:
    """Every position of a route on every way of it."""
    return positions.nearest_ways(n.i_positions, n.i_ways).select(
        "rel_osm_id", "member_type", "member_osm_id", "member_index", "way_index", "dist",
        F.round("fx", 3).alias("x"), F.round("fy", 3).alias("y"),
    )


@_query
def stop_projection_metres(n: Network) -> DataFrame:
    """The distance filter in ground metres."""
    return positions.projected_feet(n.i_positions, n.i_ways, "metre").select(
        "rel_osm_id", "member_type", "member_osm_id", "member_index", "way_index", "dist",
        F.round("fx", 3).alias("x"), F.round("fy", 3).alias("y"),
    )


@_query
def best_projection(n: Network) -> DataFrame:
    return n.best_projection


@_query
def route_position_points(n: Network) -> DataFrame:
    return n.d_routes_position.select("x", "y", "number_of_routes")


@_query
def positions_by_route(n: Network) -> DataFrame:
    spots = n.d_routes_position.select(
        F.col("id").alias("position"), F.struct(*[F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("x", "y")]).alias("spot")
    )
    rows = n.d_routes_position_ids.select("rel_osm_id", F.explode("positions_ids").alias("position")).join(spots, "position")
    return rows.groupBy("rel_osm_id").agg(
        F.count("*").cast("int").alias("n_positions"),
        F.array_join(F.transform(F.array_sort(F.collect_list("spot")), lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("positions"),
    )


@_query
def route_stop_positions(n: Network) -> DataFrame:
    return n.d_route_stop_positions.select("route_osm_id", "x", "y")


@_query
def route_stop_connections(n: Network) -> DataFrame:
    return n.d_route_stops_with_connections.select(
        "route_osm_id", "stop_osm_id", "stop_osm_type", "stop_index", "stop_name",
        _list(F.col("other_routes_at_stop"), "id", "ref", "colour").alias("other_routes_at_stop"),
    )


@_query
def stop_routes(n: Network) -> DataFrame:
    """The routes at each stop in row form, of which the connection lists are made."""
    return connections.stop_routes(n.i_positions, n.relations)


@_query
def stop_stats(n: Network) -> DataFrame:
    return n.stop_statistics.select("osm_type", "osm_id", *_STATS, _pairs())


@_query
def stop_colours(n: Network) -> DataFrame:
    return stops.stop_colours(n.position_refs, n.relations, n.i_stops)


@_query
def stops_enriched(n: Network) -> DataFrame:
    return n.d_stops.select("osm_type", "osm_id", "id", "name", *STOP_FLAGS, "local_ref", *_STATS)


@_query
def cluster_stats(n: Network) -> DataFrame:
    return n.d_stops_cluster.select(
        F.array_join("osm_type_id", ",").alias("osm_type_id"), "name", *_STATS, _pairs()
    )


@_query
def stop_shields(n: Network) -> DataFrame:
    return n.d_stops_shield.select("osm_type", "osm_id", "i", "ref", "colour")


@_query
def stations(n: Network) -> DataFrame:
    return n.d_stations.select("osm_type", "osm_id", "name", "has_polygon", *_r3("x", "y"))


@_query
def stations_area(n: Network) -> DataFrame:
    holes = F.array_join(F.transform("holes", _line), ";").alias("holes")
    return n.d_stations_area.select("osm_type", "osm_id", "name", _line(F.col("geom")).alias("geom"), holes)


@_query
def routes_at_stop(n: Network) -> DataFrame:
    return n.d_routes_at_stop


# --- documents --------------------------------------------------------------------

@_query
def route_properties(n: Network) -> DataFrame:
    return documents.route_properties(n.relations)


@_query
def route_geometry(n: Network) -> DataFrame:
    return n.d_routes.select("osm_id", F.array_join(F.transform("geom", _line), ";").alias("geometry"))


def _micro(points: Column) -> Column:
    def micro(v: Column) -> Column:
        return F.round(v * F.lit(1e6)).cast("long").cast("string")

    return F.array_join(F.transform(points, lambda p: F.concat(micro(p[0]), F.lit(" "), micro(p[1]))), ",")


@_query
def route_position_list(n: Network) -> DataFrame:
    lists = documents.stop_position_list(n.d_route_stop_positions)
    # ids are surrogates: compare in spatial order
    ordered = F.sort_array(F.transform("positions", geo.lonlat_pair))
    return lists.select(F.col("route_osm_id").alias("osm_id"), _micro(ordered).alias("stop_positions"))


def _stop_list(stops_column: Column) -> Column:
    def one(s: Column) -> Column:
        shields = F.array_join(
            F.transform(s["shields"], lambda h: F.concat(h["ref"], F.lit("/"), _txt(h["colour"]))), "+"
        )
        at = F.lit("@")
        return F.concat(_txt(s["name"]), at, _spot(s["lon"], s["lat"]), at, s["osm_id"], at, shields)

    return F.array_join(F.transform(stops_column, one), ";")


@_query
def route_stop_list(n: Network) -> DataFrame:
    lists = documents.stop_list(n.stop_connections)
    return lists.select(F.col("route_osm_id").alias("osm_id"), _stop_list(F.col("stops")).alias("stop_list"))


@_query
def route_document(n: Network) -> DataFrame:
    def lines(g: Column) -> Column:
        return F.array_join(F.transform(g["coordinates"], lambda p: _spot(p[0], p[1])), ",")

    spots = F.sort_array(F.transform(F.col("stop_positions.geometries"), lambda g: g["coordinates"]))
    return n.route_documents.select(
        "osm_id", *[F.col(f"route_info.{c}").alias(c) for c in routes.ROUTE_COLUMNS[1:]],
        _micro(spots).alias("stop_positions"), _stop_list(F.col("stop_list")).alias("stop_list"),
        F.array_join(F.transform(F.col("geometry.geometries"), lines), ";").alias("geometry"),
    )


@_query
def stop_attributes(n: Network) -> DataFrame:
    rows = documents.stop_attributes(n.i_stops)
    at = F.col("geometry.coordinates")
    return rows.select(
        *documents.STOP_PROPERTIES, F.round(at[0], 7).alias("lon"), F.round(at[1], 7).alias("lat")
    )


_VISIT = ["route_osm_id", "ref", "name", "network", "operator", "transport_mode", "origin",
          "destination", "colour"]


@_query
def stop_routes_list(n: Network) -> DataFrame:
    return documents.routes_list(n.d_routes_at_stop).select(
        "osm_type", "osm_id", _list(F.col("routes_at_stop"), *_VISIT).alias("routes_at_stop")
    )


@_query
def stop_document(n: Network) -> DataFrame:
    at = F.col("geometry.coordinates")
    return n.stop_documents.select(
        "osm_type", "osm_id", F.col("properties.osm_type").alias("word"),
        *[F.col(f"properties.{c}").alias(c) for c in ("name", "local_ref", *STOP_FLAGS)],
        _spot(at[0], at[1]).alias("spot"),
        _list(F.col("properties.routes_at_stop"), *_VISIT).alias("routes_at_stop"),
    )


@_query
def display_defaults(n: Network) -> DataFrame:
    return documents.route_display(n.relations)


@_query
def stop_badges(n: Network) -> DataFrame:
    return documents.stop_badges(n.i_stops).withColumn("badges", F.array_join("badges", ","))


@_query
def id_lists(n: Network) -> DataFrame:
    return publication.id_lists(n.i_stops, n.relations)


@_query
def document_keys(n: Network) -> DataFrame:
    return publication.document_keys(n.i_stops, n.relations)


# --- tiles ------------------------------------------------------------------------

@_query
def tile_stops_z11_13(n: Network) -> DataFrame:
    clusters = n.d_stops_cluster.withColumn("cluster_key", F.col("osm_type_id")[0])
    rows = tiles.layer_rows(clusters, tiles.STOP_CLUSTERS, tiles.STOP_CLUSTERS.queries[0])
    return rows.select(*_TILE, F.array_join("osm_type_id", ",").alias("osm_type_id"), "max_avg_distance")


@_query
def tile_stops_z14(n: Network) -> DataFrame:
    rows = tiles.layer_rows(n.d_stops, tiles.STOPS, tiles.STOPS.queries[0])
    return rows.select(*_TILE, "osm_type", "osm_id", "number_of_routes")


@_query
def tile_shields(n: Network) -> DataFrame:
    rows = tiles.layer_rows(n.d_stops_shield, tiles.STOP_SHIELDS, tiles.STOP_SHIELDS.queries[0])
    return rows.select(*_TILE, "osm_type", "osm_id", "i", "ref", "colour")


@_query
def tile_stations(n: Network) -> DataFrame:
    rows = tiles.layer_rows(n.d_stations, tiles.STATIONS, tiles.STATIONS.queries[0])
    return rows.select(*_TILE, "name", "has_polygon")


@_query
def tile_payload(n: Network) -> DataFrame:
    """The files of the stations' tiles: pixels and properties of each feature, in order."""
    rows = tiles.layer_rows(n.d_stations, tiles.STATIONS, tiles.STATIONS.queries[0], [6, 12, 14, 16])
    pixels = lambda f: F.array_join(F.transform(f["pixels"], lambda p: F.concat_ws(" ", p["px"], p["py"])), ",")
    return tiles.tile_payload(tiles.layer_features(rows, tiles.STATIONS)).select(
        "layer", "z", "x_tile", "y_tile", F.size("features").alias("n"),
        F.array_join(F.transform("features", lambda f: F.concat_ws("|", f["rank"], pixels(f), f["properties"])), ";").alias("features"),
    )


@_query
def tile_station_areas(n: Network) -> DataFrame:
    rows = tiles.layer_rows(n.d_stations_area, tiles.STATION_AREAS, tiles.STATION_AREAS.queries[0])
    return rows.select(*_TILE, "name")


def _tile_ways(n: Network, i: int) -> DataFrame:
    rows = tiles.layer_rows(n.d_ways, tiles.WAYS, tiles.WAYS.queries[i])
    return rows.select(*_TILE, "number_of_routes", *_r3("length"), _low("lon"), _low("lat"))


@_query
def tile_ways_z11(n: Network) -> DataFrame:
    return _tile_ways(n, 0)


@_query
def tile_ways_z12(n: Network) -> DataFrame:
    return _tile_ways(n, 1)


@_query
def tile_positions(n: Network) -> DataFrame:
    rows = tiles.layer_rows(n.d_routes_position, tiles.POSITIONS, tiles.POSITIONS.queries[0])
    return rows.select(*_TILE, "x", "y")
