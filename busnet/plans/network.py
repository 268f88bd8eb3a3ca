"""The derivation DAG: which table is made from which."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from busnet.operators import connections, documents, positions, routes, segments, stations, stops, tiles
from busnet.sources.features import FeatureTables, attach_member_geometry, positive_route_ids

Keep = Callable[[str, DataFrame], DataFrame]


class Network:
    """All derived tables of one extract, each built on first use.

    `keep(name, df)` may store a table and hand back the stored one (build_all does); by default
    everything stays a lazy plan.  With `share`, the documents of so many positions are made and kept at a time.
    """

    def __init__(self, features: FeatureTables, keep: Keep | None = None, share: int | None = None):
        self.features = features
        self._keep = keep or (lambda _, df: df)
        self._share = share

    # --- inputs --------------------------------------------------------------
    @cached_property
    def relations(self) -> DataFrame:
        return self._keep("t_relations", positive_route_ids(self.features.relations_route, "osm_id"))

    @cached_property
    def member_refs(self) -> DataFrame:
        return self._keep("t_member_refs", positive_route_ids(self.features.member_refs, "rel_osm_id"))

    @cached_property
    def element_geometry(self) -> DataFrame:
        return self._keep("t_element_geometry", self.features.element_geometry)

    @cached_property
    def members(self) -> DataFrame:
        return self._keep("t_members", attach_member_geometry(self.member_refs, self.element_geometry))

    # --- internal tables -----------------------------------------------------
    @cached_property
    def i_routes(self) -> DataFrame:
        return self._keep("i_routes", routes.routes_internal(self.relations, self.members))

    @cached_property
    def stops_with_shape(self) -> DataFrame:
        return self._keep(
            "t_stops_with_shape",
            stops.stops_with_shape(self.features.nodes_bus_stop, self.features.ways_bus_stop),
        )

    @cached_property
    def i_stops(self) -> DataFrame:
        return self._keep("i_stops", self.stops_with_shape.drop("geom"))

    @cached_property
    def cluster_members(self) -> DataFrame:
        return self._keep("t_cluster_members", stops.cluster_members(self.stops_with_shape))

    @cached_property
    def i_stops_cluster(self) -> DataFrame:
        return self._keep("i_stops_cluster", stops.stop_clusters(self.cluster_members))

    @cached_property
    def i_stations(self) -> DataFrame:
        f = self.features
        return self._keep("i_stations", stations.stations_union(f.nodes_bus_station, f.ways_bus_station))

    @cached_property
    def i_ways(self) -> DataFrame:
        return self._keep("i_ways", routes.route_ways(self.members))

    @cached_property
    def position_refs(self) -> DataFrame:
        return routes.position_refs(self.member_refs)

    @cached_property
    def i_positions(self) -> DataFrame:
        return self._keep("i_positions", routes.route_positions(self.members))

    # --- display tables ------------------------------------------------------
    @cached_property
    def d_routes(self) -> DataFrame:
        return self._keep("d_routes", routes.route_paths(self.relations, self.i_ways))

    @cached_property
    def stop_connections(self) -> DataFrame:
        """The stops of d_route_stops_with_connections with `shields` in place of lists, of which documents are made."""
        return connections.route_stop_connections(
            self.i_positions, self.i_stops, self.relations, lists=False, keep=self._keep
        )

    @cached_property
    def d_route_stops_with_connections(self) -> DataFrame:
        rows = connections.route_stop_connections(self.i_positions, self.i_stops, self.relations)
        return self._keep("d_route_stops_with_connections", rows.drop("shields"))

    @cached_property
    def way_routes(self) -> DataFrame:
        return self._keep(
            "t_way_routes",
            segments.way_routes(self.i_routes, self.member_refs, self.element_geometry),
        )

    @cached_property
    def way_shapes(self) -> DataFrame:
        return self._keep("t_way_shapes", segments.way_shapes(self.element_geometry))

    @cached_property
    def way_sets(self) -> DataFrame:
        return self._keep("t_way_sets", segments.route_sets(self.way_routes))

    @cached_property
    def street_lines(self) -> DataFrame:
        return self._keep("t_street_lines", segments.street_lines(self.way_sets, self.way_shapes))

    @cached_property
    def segments(self) -> DataFrame:
        return self._keep("t_segments", segments.segments_merged(self.way_sets, self.street_lines))

    @cached_property
    def d_ways(self) -> DataFrame:
        return self._keep("d_ways", self.segments.drop("set_a", "set_b", "n_edges"))

    @cached_property
    def route_segments(self) -> DataFrame:
        return segments.segments_of_routes(
            self.segments, segments.set_routes(self.way_sets, self.way_routes)
        )

    @cached_property
    def d_routes_ways_ids(self) -> DataFrame:
        return self._keep("d_routes_ways_ids", segments.segments_by_route(self.route_segments))

    @cached_property
    def feet(self) -> DataFrame:
        return positions.projected_feet(self.i_positions, self.i_ways)

    @cached_property
    def best_projection(self) -> DataFrame:
        return self._keep(
            "t_best_projection", positions.best_projection(self.feet, self.i_stops, self.relations)
        )

    @cached_property
    def d_route_stop_positions(self) -> DataFrame:
        return self._keep(
            "d_route_stop_positions", positions.route_stop_positions(self.best_projection, self.d_routes_position)
        )

    @cached_property
    def d_routes_position(self) -> DataFrame:
        return self._keep("d_routes_position", positions.position_points(self.best_projection))

    @cached_property
    def d_routes_position_ids(self) -> DataFrame:
        return self._keep("d_routes_position_ids", positions.positions_by_route(self.d_route_stop_positions))

    @cached_property
    def stop_statistics(self) -> DataFrame:
        return self._keep("t_stop_statistics", stops.stop_statistics(self.position_refs, self.i_routes, self.i_stops))

    @cached_property
    def stops_enriched(self) -> DataFrame:
        return stops.stops_enriched(self.i_stops, self.stop_statistics)

    @cached_property
    def d_stops(self) -> DataFrame:
        return self._keep("d_stops", self.stops_enriched.drop("routes_ref_colour"))

    @cached_property
    def d_stops_shield(self) -> DataFrame:
        return self._keep("d_stops_shield", stops.stop_shields(self.stops_enriched))

    @cached_property
    def d_stops_cluster(self) -> DataFrame:
        return self._keep(
            "d_stops_cluster",
            stops.clusters_enriched(
                self.i_stops_cluster, stops.cluster_statistics(self.cluster_members, self.stop_statistics)
            ),
        )

    @cached_property
    def d_stations(self) -> DataFrame:
        return self._keep("d_stations", stations.stations(self.i_stations))

    @cached_property
    def d_stations_area(self) -> DataFrame:
        return self._keep("d_stations_area", stations.station_areas(self.i_stations))

    @cached_property
    def d_routes_at_stop(self) -> DataFrame:
        return self._keep(
            "d_routes_at_stop",
            connections.routes_at_stop(self.i_stops, self.position_refs, self.relations),
        )

    # --- documents and tiles -------------------------------------------------
    @cached_property
    def route_documents(self) -> DataFrame:
        """Documents of all routes.  They are made in shares by the hash of the route, so what is dealt for one share is gone
        before the next."""
        tables = [("osm_id", self.d_routes), ("route_osm_id", self.d_route_stop_positions), ("route_osm_id", self.stop_connections)]
        shares = 1 + self.i_positions.count() // self._share if self._share else 1
        if shares == 1:
            return documents.route_documents(*[df for _, df in tables])

        def share(i: int) -> DataFrame:
            return documents.route_documents(*[df.filter(F.pmod(F.xxhash64(key), F.lit(shares)) == i) for key, df in tables])

        return reduce(DataFrame.unionByName, [self._keep("t_route_documents", share(i)) for i in range(shares)])

    @cached_property
    def stop_documents(self) -> DataFrame:
        return documents.stop_documents(self.i_stops, self.d_routes_at_stop)

    def layer_sources(self) -> list[tuple[tiles.Layer, DataFrame]]:
        keyed = self.d_stops_cluster.withColumn("cluster_key", F.col("osm_type_id")[0])
        return [
            (tiles.STOP_CLUSTERS, keyed), (tiles.STOPS, self.d_stops),
            (tiles.STOP_SHIELDS, self.d_stops_shield), (tiles.STATIONS, self.d_stations),
            (tiles.STATION_AREAS, self.d_stations_area), (tiles.WAYS, self.d_ways),
            (tiles.POSITIONS, self.d_routes_position),
        ]

    def tile_features(self, zooms=None, extent=tiles.WORLD) -> DataFrame:
        parts = [
            tiles.layer_features(tiles.layer_rows(df, layer, query, zooms, extent), layer)
            for layer, df in self.layer_sources()
            for query in layer.queries
            if any(query.minzoom <= z <= query.maxzoom for z in (zooms or range(tiles.MIN_ZOOM, tiles.MAX_ZOOM + 1)))
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


TABLES = [
    "i_routes", "i_stops", "i_stops_cluster", "i_stations", "i_ways", "i_positions",
    "d_routes", "d_route_stops_with_connections", "d_ways", "d_routes_ways_ids",
    "d_routes_position", "d_routes_position_ids", "d_route_stop_positions",
    "d_stops", "d_stops_cluster", "d_stops_shield", "d_stations", "d_stations_area", "d_routes_at_stop",
]
