"""Street segments: ways dissolved by the set of routes that use them, merged end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busnet.functions import geo
from busnet.functions.tags import WAY
from busnet.operators import ids, noding, ranking
from busnet.operators.routes import path_members
from busnet.session import cut_lineage

_SHAPE = ["shape_a", "shape_b"]
_SET = ["set_a", "set_b"]


def _fingerprint(names: list[str], *parts: Column) -> list[Column]:
    """Two 64-bit hashes, used together as one 128-bit identity.

    The salt comes first: each part is hashed with the state of those before it, so a salt at the
    end would make both hashes functions of one 64-bit state.
    """
    return [F.xxhash64(F.lit(i), *parts).alias(n) for i, n in enumerate(names)]


def way_routes(routes: DataFrame, member_refs: DataFrame, element_geometry: DataFrame) -> DataFrame:
    """(shape_a, shape_b, rel_osm_id, diameter): the routes on each distinct way geometry.

    Only ids travel with the (large) member table; ways with the same vertex sequence share one
    shape, so a street drawn twice counts once.
    """
    shapes = element_geometry.filter((F.col("member_type") == WAY) & F.col("geom").isNotNull()).select(
        "member_osm_id", *_fingerprint(_SHAPE, F.col("geom"))
    )
    known = routes.select(F.col("osm_id").alias("rel_osm_id"), "diameter")
    return (
        path_members(member_refs)
        .select("rel_osm_id", "member_osm_id")
        .join(known, "rel_osm_id")
        .join(shapes, "member_osm_id")
        .select(*_SHAPE, "rel_osm_id", "diameter")
        .distinct()
    )


def way_shapes(element_geometry: DataFrame) -> DataFrame:
    """(shape_a, shape_b, geom), one row per distinct way geometry."""
    return (
        element_geometry.filter((F.col("member_type") == WAY) & F.col("geom").isNotNull())
        .select(*_fingerprint(_SHAPE, F.col("geom")), "geom")
        .dropDuplicates(_SHAPE)
    )


def route_sets(used: DataFrame) -> DataFrame:
    """Per way shape: largest diameter, number of routes and an identity of the route set.

    The set is folded into a 128-bit order-free fingerprint (xor of hashes of its distinct ids),
    so a street used by very many routes never becomes one large array.
    """
    rel = F.col("rel_osm_id")
    folded = used.groupBy(*_SHAPE).agg(
        F.max("diameter").alias("max_diameter"),
        F.count("*").cast("int").alias("number_of_routes"),
        F.min(rel).alias("first_rel"),
        F.max(rel).alias("last_rel"),
        F.bit_xor(F.xxhash64(F.lit(0), rel)).alias("xa"),
        F.bit_xor(F.xxhash64(F.lit(1), rel)).alias("xb"),
    )
    parts = [F.col(c) for c in ("xa", "xb", "number_of_routes", "first_rel", "last_rel")]
    return folded.select(*_SHAPE, *_fingerprint(_SET, *parts), "max_diameter", "number_of_routes")


def segment_route_sets(used: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per way geometry and route: the set in row form, with max_diameter and number_of_routes."""
    return (
        used.select(*_SHAPE, "rel_osm_id")
        .join(route_sets(used), _SHAPE)
        .join(shapes, _SHAPE)
        .select("geom", "max_diameter", "number_of_routes", "rel_osm_id")
    )


def _edges(sets: DataFrame, shapes: DataFrame) -> DataFrame:
    """Distinct undirected vertex pairs of each route set."""
    pairs = sets.select(*_SHAPE, *_SET).join(shapes, _SHAPE).select(
        *_SET, F.explode(geo.segments(F.col("geom"))).alias("s")
    )
    return (
        pairs.filter(F.col("s.a") != F.col("s.b"))
        .select(*_SET, F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b"))
        .distinct()
    )


def street_lines(sets: DataFrame, shapes: DataFrame) -> DataFrame:
    """(set_a, set_b, line, u, v, d): the edges of each merged line in order, see `ranking.ranked`.

    Edges of one set are split where they cross or touch; those that then meet at a vertex no third edge of the set
    touches belong to one line.
    """
    edges = cut_lineage(_edges(sets, shapes))
    return ranking.ranked(noding.noded(edges, _SET), _SET)


def segments_merged(sets: DataFrame, lines: DataFrame) -> DataFrame:
    """d_ways plus its set key: (id, set_a, set_b, max_diameter, number_of_routes, n_edges, length, geom).

    `length` is the planar Web Mercator length.  The vertices of a line sit together only here, as they are one value
    of the result; `ranking.vertices` is their row form.  Ids are numbered by least vertex and last edge.
    """
    a, b = F.col("u"), F.col("v")
    dx = geo.mercator_x(b["lon"]) - geo.mercator_x(a["lon"])
    dy = geo.mercator_y(b["lat"]) - geo.mercator_y(a["lat"])
    merged = lines.groupBy(*_SET, "line").agg(
        F.count("*").cast("int").alias("n_edges"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"),
        F.array_sort(F.collect_list(F.struct(F.negative("d").alias("d"), "u"))).alias("path"),
        F.min(F.struct("d", "v")).alias("last"),
        F.min(F.least("u", "v")).alias("low"),
    )
    facts = sets.select(*_SET, "max_diameter", "number_of_routes").dropDuplicates(_SET)
    rows = merged.join(facts, _SET).select(
        *_SET, "line", "low", "max_diameter", "number_of_routes", "n_edges", "length",
        F.concat(F.transform("path", lambda p: p["u"]), F.array("last.v")).alias("geom"),
    )
    return ids.numbered(rows, ["low", *_SET, "line"]).select(
        "id", *_SET, "max_diameter", "number_of_routes", "n_edges", "length", "geom"
    )


def set_routes(sets: DataFrame, used: DataFrame) -> DataFrame:
    """(set_a, set_b, rel_osm_id): the routes of each set, in row form."""
    return used.select(*_SHAPE, "rel_osm_id").join(sets.select(*_SHAPE, *_SET), _SHAPE).select(
        *_SET, "rel_osm_id"
    ).distinct()


def segments_of_routes(merged: DataFrame, routes_of_set: DataFrame) -> DataFrame:
    """(rel_osm_id, id): the segments of each route, in row form."""
    return merged.select(*_SET, "id").join(routes_of_set, _SET).select("rel_osm_id", "id")


def segments_by_route(pairs: DataFrame) -> DataFrame:
    """d_routes_ways_ids: the list is the value of the result; `segments_of_routes` is its row form."""
    return pairs.groupBy("rel_osm_id").agg(F.sort_array(F.collect_list("id")).alias("ways_ids"))
