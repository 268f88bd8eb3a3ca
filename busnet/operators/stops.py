"""Stops, same-name stop clusters and their route statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from busnet.functions import geo
from busnet.functions.tags import NODE, WAY, element_label, falsy, name_key, sort_nulls_last
from busnet.operators.graph import connected_components
from busnet.operators.routes import with_centroid
from busnet.schemas import STOP_FLAGS
from busnet.session import cut_lineage

BUFFER = 200  # metres around a stop; two stops of one name touch within twice that
REACH = 2 * BUFFER

STOP_COLUMNS = ["osm_type", "osm_id", "id", "name", *STOP_FLAGS, "local_ref", "x", "y", "lon", "lat"]


def stops_with_shape(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """i_stops plus `geom`, the original point or line that clustering measures from."""
    columns = ["osm_type", "osm_id", "id", "name", *STOP_FLAGS, "local_ref", "geom"]
    both = (
        nodes.withColumn("osm_type", F.lit(NODE)).select(*columns)
        .unionByName(ways.withColumn("osm_type", F.lit(WAY)).select(*columns))
        .distinct()
    )
    return with_centroid(both).select(*STOP_COLUMNS, "geom")


def stops(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """i_stops: node stops at their point, way stops at their centroid."""
    return stops_with_shape(nodes, ways).select(*STOP_COLUMNS)


# --- grid: cells so small that everything inside one cell is within REACH -----

_ROW = 0.0025  # degrees of latitude, at most 279.3 m; the cell diagonal is at most 395 m
_MIN_COS = 0.01
_METRES_MIN = math.radians(geo.A * (1 - geo.E2))  # per degree, shortest radius of curvature
_METRES_MAX = math.radians(geo.A / math.sqrt(1 - geo.E2))  # longest


def _row(lat: Column) -> Column:
    return F.floor((lat + 90) / F.lit(_ROW)).cast("int")


def _edges(row: Column) -> tuple[Column, Column]:
    """Absolute latitudes of a row's edges: nearer the equator, nearer the pole."""
    a, b = F.abs(row * F.lit(_ROW) - 90), F.abs((row + 1) * F.lit(_ROW) - 90)
    return F.least(a, b), F.greatest(a, b)


def _cos(lat: Column) -> Column:
    return F.greatest(F.cos(F.radians(lat)), F.lit(_MIN_COS))


def _width(row: Column) -> Column:
    return F.lit(_ROW) / _cos(_edges(row)[0])


def _col(lon: Column, row: Column) -> Column:
    return F.floor((lon + 180) / _width(row)).cast("int")


def _reach_degrees(row_a: Column, row_b: Column, metres: float) -> Column:
    far = F.greatest(_edges(row_a)[1], _edges(row_b)[1])
    return F.lit(metres * 1.002 / math.radians(geo.A)) / _cos(far)


def _sequence(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _clip(df: DataFrame) -> DataFrame:
    """Cut each segment to its cell (row, col); rows whose segment misses the cell go away."""

    def span(a: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        safe = F.when(d != 0, d)
        t, u = (lo - a) / safe, (hi - a) / safe
        return F.coalesce(F.least(t, u), F.lit(0.0)), F.coalesce(F.greatest(t, u), F.lit(1.0))

    dlon, dlat = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    width, lat0 = _width(F.col("row")), F.col("row") * F.lit(_ROW) - 90
    lon0 = F.col("col") * width - 180
    t_lat, u_lat = span(F.col("lat1"), dlat, lat0, lat0 + F.lit(_ROW))
    t_lon, u_lon = span(F.col("lon1"), dlon, lon0, lon0 + width)
    t = F.greatest(F.lit(0.0), t_lat, t_lon)
    u = F.least(F.lit(1.0), u_lat, u_lon)

    def at(start: str, d: Column, v: str, end: str) -> Column:
        return F.when(F.col(v) == 0, F.col(start)).when(F.col(v) == 1, F.col(end)).otherwise(
            F.col(start) + d * F.col(v)
        )

    cut = df.withColumn("t", t).withColumn("u", u).filter(F.col("t") <= F.col("u"))
    return cut.select(
        "sid", "key", "row", "col",
        at("lon1", dlon, "t", "lon2").alias("lon1"), at("lat1", dlat, "t", "lat2").alias("lat1"),
        at("lon1", dlon, "u", "lon2").alias("lon2"), at("lat1", dlat, "u", "lat2").alias("lat2"),
    )


def _pieces(named: DataFrame) -> DataFrame:
    """Points and line segments of the stops, cut along the grid."""
    geom = F.col("geom")
    pairs = F.when(
        F.size(geom) == 1, F.array(F.struct(geom[0].alias("a"), geom[0].alias("b")))
    ).otherwise(geo.segments(geom))
    segs = named.select("sid", "key", F.explode(pairs).alias("s")).select(
        "sid", "key", F.col("s.a.lon").alias("lon1"), F.col("s.a.lat").alias("lat1"),
        F.col("s.b.lon").alias("lon2"), F.col("s.b.lat").alias("lat2"),
    )
    lat_lo, lat_hi = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    lon_lo, lon_hi = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    rows = segs.withColumn("row", F.explode(_sequence(_row(lat_lo), _row(lat_hi))))
    row = F.col("row")
    return _clip(rows.withColumn("col", F.explode(_sequence(_col(lon_lo, row), _col(lon_hi, row)))))


_CELL = ["key", "row", "col"]
_COORDS = ["lon1", "lat1", "lon2", "lat2"]


def _box() -> list[Column]:
    return [
        F.min(F.least("lon1", "lon2")).alias("lon_lo"), F.max(F.greatest("lon1", "lon2")).alias("lon_hi"),
        F.min(F.least("lat1", "lat2")).alias("lat_lo"), F.max(F.greatest("lat1", "lat2")).alias("lat_hi"),
    ]


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _verdict() -> Column:
    """true/false where the boxes of a_ and b_ decide whether they lie within REACH, NULL if open."""
    c = {s + k: F.col(s + k) for s in ("a_", "b_") for k in ("lon_lo", "lon_hi", "lat_lo", "lat_hi")}
    zero = F.lit(0.0)
    gap_lon = F.greatest(zero, c["b_lon_lo"] - c["a_lon_hi"], c["a_lon_lo"] - c["b_lon_hi"])
    gap_lat = F.greatest(zero, c["b_lat_lo"] - c["a_lat_hi"], c["a_lat_lo"] - c["b_lat_hi"])
    span_lon = F.greatest(c["a_lon_hi"], c["b_lon_hi"]) - F.least(c["a_lon_lo"], c["b_lon_lo"])
    span_lat = F.greatest(c["a_lat_hi"], c["b_lat_hi"]) - F.least(c["a_lat_lo"], c["b_lat_lo"])
    lats = [F.abs(c[s + k]) for s in ("a_", "b_") for k in ("lat_lo", "lat_hi")]
    cos_far, cos_near = F.cos(F.radians(F.greatest(*lats))), F.cos(F.radians(F.least(*lats)))

    def length(lon: Column, lat: Column, per_degree: float, cos: Column) -> Column:
        east, north = lon * cos * per_degree, lat * per_degree
        return F.sqrt(east * east + north * north)

    # a box may straddle the equator, where the nearest latitude is 0
    cos_near = F.when(
        F.least(c["a_lat_lo"], c["b_lat_lo"]) * F.greatest(c["a_lat_hi"], c["b_lat_hi"]) <= 0, F.lit(1.0)
    ).otherwise(cos_near)
    at_least = length(gap_lon, gap_lat, _METRES_MIN, cos_far) * 0.9999
    at_most = length(span_lon, span_lat, _METRES_MAX, cos_near) * 1.0001
    return F.when(at_least > REACH, F.lit(False)).when(at_most <= REACH, F.lit(True))


def _piece_distance() -> Column:
    a = {k: F.col("a_" + k) for k in _COORDS}
    b = {k: F.col("b_" + k) for k in _COORDS}
    return geo.segment_distance(a, b)


def _near_cells(cells: DataFrame) -> DataFrame:
    """Candidate pairs of different cells of one key that may lie within REACH, each pair once."""
    row, other = F.col("a_row"), F.col("b_row")
    reach = _reach_degrees(row, other, REACH)
    lo = F.when(other == row, F.col("a_col") + 1).otherwise(_col(F.col("a_lon_lo") - reach, other))
    probes = (
        _side(cells, "a_")
        .withColumn("b_row", F.explode(F.sequence(row, row + 2)))
        .withColumn("b_col", F.explode(_sequence(lo, _col(F.col("a_lon_hi") + reach, other))))
        .withColumn("b_key", F.col("a_key"))
    )
    return probes.join(_side(cells, "b_"), ["b_key", "b_row", "b_col"])


def _cell_links(cells: DataFrame, pieces: DataFrame, leaf: int) -> DataFrame:
    """(src, dst) representatives of cells that touch within REACH.

    Boxes decide most pairs of cells.  Open pairs of at most `leaf` pairs of pieces compare them; others
    are quartered until the boxes decide or so few are left.  The result does not depend on `leaf`.
    """
    pairs = cut_lineage(_near_cells(cells).withColumn("close", _verdict()).filter(
        F.col("close").isNull() | F.col("close")
    ))
    links = [pairs.filter("close").select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst"))]
    shapes = pieces.select(*_CELL, *_COORDS).distinct()
    crowded = F.col("a_n") * F.col("b_n") > leaf
    open_pairs = pairs.filter("close IS NULL")

    few = open_pairs.filter(~crowded).select(
        "a_key", "a_row", "a_col", "b_key", "b_row", "b_col", "a_rep", "b_rep"
    )
    links.append(_compare(few, shapes, _CELL))

    many = open_pairs.filter(crowded)
    if not many.isEmpty():
        links.append(_halve(many, shapes, leaf))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _compare(pairs: DataFrame, shapes: DataFrame, cell: list[str]) -> DataFrame:
    """Links of the listed cell pairs that hold two pieces within REACH."""
    return (
        pairs.join(_side(shapes, "a_"), ["a_" + c for c in cell])
        .join(_side(shapes, "b_"), ["b_" + c for c in cell])
        .filter(_piece_distance() <= REACH)
        .select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst"))
        .distinct()
    )


_MAX_LEVEL = 15  # 279 m / 2^15 is under the 1 cm step of OSM coordinates


def _halve(pairs: DataFrame, shapes: DataFrame, leaf: int) -> DataFrame:
    """Links of crowded cell pairs: quarter the cells, let the boxes decide, repeat on the rest."""
    wanted = pairs.select(*[F.col("a_" + c).alias(c) for c in _CELL]).unionByName(
        pairs.select(*[F.col("b_" + c).alias(c) for c in _CELL])
    ).distinct()
    shapes = cut_lineage(shapes.join(wanted, _CELL, "left_semi"))
    base = ["a_key", "a_row", "a_col", "b_key", "b_row", "b_col", "a_rep", "b_rep"]
    todo = pairs.select(*base)
    spot = ["p_lon", "p_lat"]
    found, level = [], 0
    while True:
        level += 1
        step_lat = _ROW / 2**level
        cut = shapes.withColumn(
            "p_lon", F.floor((F.col("lon1") + 180) / (_width(F.col("row")) / 2**level))
        ).withColumn("p_lat", F.floor((F.col("lat1") + 90) / F.lit(step_lat)))
        parts = cut.groupBy(*_CELL, *spot).agg(F.count("*").alias("n"), *_box())
        if level == 1:
            children = todo.join(_side(parts, "a_"), ["a_key", "a_row", "a_col"]).join(
                _side(parts, "b_"), ["b_key", "b_row", "b_col"]
            )
        else:
            up = parts.withColumn("u_lon", F.floor(F.col("p_lon") / 2)).withColumn(
                "u_lat", F.floor(F.col("p_lat") / 2)
            )
            children = todo.join(
                _side(up, "a_"), ["a_key", "a_row", "a_col", "a_u_lon", "a_u_lat"]
            ).join(_side(up, "b_"), ["b_key", "b_row", "b_col", "b_u_lon", "b_u_lat"])
        judged = cut_lineage(children.withColumn("close", _verdict()).filter(
            F.col("close").isNull() | F.col("close")
        ))
        linked = judged.filter("close").select("a_rep", "b_rep").distinct()
        rest = judged.filter("close IS NULL").join(linked, ["a_rep", "b_rep"], "left_anti")
        crowded = (F.col("a_n") * F.col("b_n") > leaf) & F.lit(level < _MAX_LEVEL)
        keys = [s + c for s in ("a_", "b_") for c in (*_CELL, *spot)]
        few = rest.filter(~crowded).select(*keys, "a_rep", "b_rep")
        found.append(linked.select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst")))
        found.append(_compare(few, cut, [*_CELL, *spot]))
        many = rest.filter(crowded)
        if many.isEmpty():
            break
        todo = many.select(
            *base,
            *[F.col(s + p).alias(s + p.replace("p_", "u_")) for s in ("a_", "b_") for p in spot],
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _shape_distance(lon: Column, lat: Column, geom: Column) -> Column:
    """Metres from a spot to a line."""
    spot = {"lon1": lon, "lat1": lat, "lon2": lon, "lat2": lat}

    def one(s: Column) -> Column:
        return geo.segment_distance(
            {"lon1": s["a"]["lon"], "lat1": s["a"]["lat"], "lon2": s["b"]["lon"], "lat2": s["b"]["lat"]},
            spot,
        )

    return F.array_min(F.transform(geo.segments(geom), one))


def cluster_members(shaped: DataFrame, leaf: int = 10_000) -> DataFrame:
    """(cluster_id, osm_type, osm_id, name, x, y): stops of one name linked by 400 m steps.

    Unnamed stops stand alone.  A way stop belongs to the cluster whose 200 m surroundings hold
    its centroid, which can be another cluster of its name, or none: then it is left out.
    """
    sid = F.col("osm_id") * 2 + F.col("osm_type")
    # stored, as a filter on at_home would else be worked out again below the joins, for every line of the extract
    base = cut_lineage(shaped.withColumn("sid", sid).withColumn(
        "key", name_key(F.col("name"), F.col("osm_type"), F.col("osm_id"))
    ).withColumn(
        "at_home",
        F.when(F.size("geom") == 1, F.lit(True)).otherwise(
            F.coalesce(_shape_distance(F.col("lon"), F.col("lat"), F.col("geom")) < BUFFER, F.lit(False))
        ),
    ))
    keep = ["osm_type", "osm_id", "name", "x", "y"]
    unnamed = base.filter(falsy(F.col("name"))).filter("at_home")
    alone = unnamed.select(F.col("sid").alias("cluster_id"), *keep)

    named = base.filter(~falsy(F.col("name")))
    pieces = cut_lineage(_pieces(named))
    cells = cut_lineage(
        pieces.groupBy(*_CELL).agg(
            F.min("sid").alias("rep"), F.count("*").alias("n"), *_box()
        )
    )
    home = pieces.select("sid", *_CELL).distinct().join(cells.select(*_CELL, "rep"), _CELL)
    # a way crossing several cells ties them together; a node has one cell only
    crossing = home.filter(F.col("sid") % 2 == WAY).select(F.col("sid").alias("src"), F.col("rep").alias("dst"))
    component = connected_components(
        _cell_links(cells, pieces, leaf).unionByName(crossing)
    ).select(F.col("id").alias("rep"), "component")
    cell_cluster = cut_lineage(
        cells.join(component, "rep", "left").select(
            *_CELL, F.coalesce("component", "rep").alias("cluster_id")
        )
    )
    settled = (
        named.filter("at_home").select("sid", *keep)
        .join(pieces.select("sid", *_CELL).dropDuplicates(["sid"]), "sid")
        .join(cell_cluster, _CELL)
        .select("cluster_id", *keep)
    )
    row = _row(F.col("lat"))
    reach = _reach_degrees(F.col("row"), row, BUFFER)
    strays = (
        named.filter("NOT at_home")
        .withColumn("row", F.explode(F.sequence(row - 1, row + 1)))
        .withColumn(
            "col",
            F.explode(_sequence(_col(F.col("lon") - reach, F.col("row")), _col(F.col("lon") + reach, F.col("row")))),
        )
        .select("sid", "key", "row", "col", "lon", "lat", *keep)
    )
    spot = {"lon1": F.col("lon"), "lat1": F.col("lat"), "lon2": F.col("lon"), "lat2": F.col("lat")}
    taken_in = (
        strays.join(pieces.select(*_CELL, *_COORDS).distinct(), _CELL)
        .filter(geo.segment_distance({k: F.col(k) for k in _COORDS}, spot) < BUFFER)
        .join(cell_cluster, _CELL)
        .select("cluster_id", *keep)
        .distinct()
    )
    return settled.unionByName(alone).unionByName(taken_in)


def stop_clusters(members: DataFrame) -> DataFrame:
    """i_stops_cluster: the parallel arrays of a cluster's stops, its name and mean position."""
    grouped = members.groupBy("cluster_id", "name").agg(
        F.sort_array(F.collect_list(F.struct("osm_type", "osm_id"))).alias("m"),
        F.avg("x").alias("x"), F.avg("y").alias("y"),
    )
    return grouped.select(
        "cluster_id",
        F.transform("m", lambda s: element_label(s["osm_type"], s["osm_id"])).alias("osm_type_id"),
        F.transform("m", lambda s: s["osm_type"]).alias("osm_type"),
        F.transform("m", lambda s: s["osm_id"]).alias("osm_id"),
        "name", "x", "y",
    )


def stop_statistics(positions: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Per stop: largest diameter and spacing, number of visits, distinct (ref, colour) pairs.

    Positions that are no stops (a stop_position node, for example) are left out first.
    """
    known_stops = stops.select(F.col("osm_type").alias("member_type"), F.col("osm_id").alias("member_osm_id"))
    known = routes.select(
        F.col("osm_id").alias("rel_osm_id"), "ref", "colour", "diameter", "avg_distance"
    )
    return (
        positions.select("rel_osm_id", "member_type", "member_osm_id")
        .join(known_stops, ["member_type", "member_osm_id"], "left_semi")
        .join(known, "rel_osm_id")
        .groupBy(F.col("member_type").alias("osm_type"), F.col("member_osm_id").alias("osm_id"))
        .agg(
            F.max("diameter").alias("max_diameter"),
            F.max("avg_distance").alias("max_avg_distance"),
            F.count("*").cast("int").alias("number_of_routes"),
            F.collect_set(F.struct("ref", "colour")).alias("pairs"),
        )
        .withColumn("routes_ref_colour", sort_nulls_last(F.col("pairs"), "ref", "colour"))
        .drop("pairs")
    )


def stop_colours(positions: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(osm_type, osm_id, ref, colour): the distinct lines at each stop, in row form."""
    known_stops = stops.select(F.col("osm_type").alias("member_type"), F.col("osm_id").alias("member_osm_id"))
    known = routes.select(F.col("osm_id").alias("rel_osm_id"), "ref", "colour")
    return (
        positions.select("rel_osm_id", "member_type", "member_osm_id")
        .join(known_stops, ["member_type", "member_osm_id"], "left_semi")
        .join(known, "rel_osm_id")
        .select(F.col("member_type").alias("osm_type"), F.col("member_osm_id").alias("osm_id"), "ref", "colour")
        .distinct()
    )


def stops_enriched(all_stops: DataFrame, statistics: DataFrame) -> DataFrame:
    """d_stops (with routes_ref_colour): a stop without routes has NULL statistics."""
    return all_stops.join(statistics, ["osm_type", "osm_id"], "left")


def cluster_statistics(members: DataFrame, statistics: DataFrame) -> DataFrame:
    """Per cluster, from its stops' statistics (so hot stops are already reduced).

    The (ref, colour) pairs become rows, distinct before they are gathered.
    """
    known = members.select("cluster_id", "osm_type", "osm_id").join(statistics, ["osm_type", "osm_id"])
    pairs = (
        known.select("cluster_id", F.explode("routes_ref_colour").alias("pair")).distinct()
        .groupBy("cluster_id").agg(F.collect_list("pair").alias("pairs"))
    )
    return (
        known.groupBy("cluster_id")
        .agg(
            F.max("max_diameter").alias("max_diameter"),
            F.max("max_avg_distance").alias("max_avg_distance"),
            F.sum("number_of_routes").cast("int").alias("number_of_routes"),
        )
        .join(pairs, "cluster_id")
        .withColumn("routes_ref_colour", sort_nulls_last(F.col("pairs"), "ref", "colour"))
        .drop("pairs")
    )


def clusters_enriched(clusters: DataFrame, statistics: DataFrame) -> DataFrame:
    """d_stops_cluster."""
    return clusters.join(statistics, "cluster_id", "left")


def stop_shields(enriched: DataFrame) -> DataFrame:
    """d_stops_shield: one row per (ref, colour) of a stop, numbered from 1."""
    return enriched.select(
        "osm_type", "osm_id", "x", "y", F.posexplode("routes_ref_colour").alias("pos", "pair")
    ).select(
        "osm_type", "osm_id", (F.col("pos") + 1).alias("i"), F.col("pair.ref").alias("ref"),
        F.when(falsy(F.col("pair.colour")), "gray").otherwise(F.col("pair.colour")).alias("colour"),
        "x", "y",
    )
