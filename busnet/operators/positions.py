"""Stops projected on the path of their route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busnet.functions import geo
from busnet.functions.tags import element_label
from busnet.operators import ids
from busnet.session import cut_lineage

MAX_DISTANCE = 20  # compared with degrees by default, as in the published maps
_TIE = 9  # distances equal to 1e-9 degrees (0.1 mm) are ties; OSM stores 1e-7
_GRID = 3  # a projected point is identified by whole millimetres


_SPOT = ["x", "y", "lon", "lat"]


def _foot(p: Column | dict[str, Column], segments: Column) -> Column:
    """(d2, fx, fy): the nearest point in the plane of the segments to the spot p.

    The least is taken inside the row, so a pair of a position and a way is never unfolded into rows that have to be sorted.
    """
    def along(s: Column) -> Column:
        part = ((p["x"] - s["ax"]) * s["dx"] + (p["y"] - s["ay"]) * s["dy"]) / s["len2"]
        return F.when(s["len2"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))).otherwise(F.lit(0.0))

    def at(s: Column, t: Column) -> Column:
        return F.struct((s["ax"] + s["dx"] * t).alias("fx"), (s["ay"] + s["dy"] * t).alias("fy"))

    def off(f: Column) -> Column:
        dx, dy = f["fx"] - p["x"], f["fy"] - p["y"]
        return F.struct((dx * dx + dy * dy).alias("d2"), f["fx"].alias("fx"), f["fy"].alias("fy"))

    return F.array_min(F.transform(F.zip_with(segments, F.transform(segments, along), at), off))


def _dist(p: Column | dict[str, Column], f: Column) -> Column:
    """Degrees from the spot p to the foot f, rounded to the tie grid."""
    dlon, dlat = geo.lon_of(f["fx"]) - p["lon"], geo.lat_of(f["fy"]) - p["lat"]
    return F.round(F.sqrt(dlon * dlon + dlat * dlat), _TIE)


def _near(p: Column | dict[str, Column], hit: Column, unit: str) -> Column:
    """Whether a hit passes the distance filter."""
    if unit == "degree":
        return hit["dist"] < MAX_DISTANCE
    if unit == "metre":
        lat = geo.lat_of(hit["fy"])
        metres = geo.spheroid_distance(p["lon"], p["lat"], geo.lon_of(hit["fx"]), lat)
        # a degree of latitude has more than 110,000 metres: most ways are further off by that alone
        return (F.abs(lat - p["lat"]) * 110000 <= MAX_DISTANCE) & (metres < MAX_DISTANCE)
    raise ValueError(f"unknown unit {unit!r}")


def _hits(pairs: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """keys, x, y, lon, lat, dist, fx, fy: the foot of the spots of each row on its segments, unless it is too far."""
    def nearest(p: Column) -> Column:
        return geo.let(_foot(p, F.col("segments")), lambda f: F.struct(*[f[c].alias(c) for c in ("d2", "fx", "fy")], *[p[c].alias(c) for c in _SPOT]))

    hit = geo.let(F.array_min(F.transform("spots", nearest)), lambda f: F.struct(_dist(f, f).alias("dist"), *[f[c].alias(c) for c in (*_SPOT, "fx", "fy")]))
    near = F.filter(F.array(hit), lambda h: _near(h, h, unit))
    # unfolded, not filtered: a condition would be moved below and the foot worked out again
    return pairs.select(*keys, F.explode(near).alias("h")).select(*keys, *[f"h.{c}" for c in (*_SPOT, "dist", "fx", "fy")])


def _segments(geom: Column) -> Column:
    """A line as planar segments; a single vertex becomes a zero-length segment."""
    def one(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        return F.struct(
            s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), dx.alias("dx"), dy.alias("dy"), (F.pow(dx, F.lit(2)) + F.pow(dy, F.lit(2))).alias("len2")
        )

    pts = geo.planar(F.when(F.size(geom) == 1, F.concat(geom, geom)).otherwise(geom))
    return F.transform(geo.segments(pts), one)


def _with_segments(ways: DataFrame) -> DataFrame:
    return ways.filter(F.col("geom").isNotNull()).select(
        "rel_osm_id", F.col("index").alias("way_index"), "geom", _segments(F.col("geom")).alias("segments")
    )


def _lines(ways: DataFrame) -> DataFrame:
    """(rel_osm_id, way_index, segments): all segments of each member of a route."""
    return _with_segments(ways).groupBy("rel_osm_id", "way_index").agg(F.flatten(F.collect_list("segments")).alias("segments"))


def _route_lines(ways: DataFrame) -> DataFrame:
    """(rel_osm_id, lines): the ways of each route, (way_index, segments), in one row."""
    found, places = F.col("found"), F.transform("found", lambda w: w["index"])
    alone = F.transform(found, lambda w: F.struct(w["index"].alias("way_index"), _segments(w["geom"]).alias("segments")))
    # a place that several lines claim is one way
    merged = F.transform(F.array_distinct(places), lambda i: F.struct(
        i.alias("way_index"), F.flatten(F.transform(F.filter(found, lambda w: w["index"] == i), lambda w: _segments(w["geom"]))).alias("segments")
    ))
    return ways.groupBy("rel_osm_id").agg(F.collect_list(F.struct("index", "geom")).alias("found")).select(
        "rel_osm_id", F.when(F.size(F.array_distinct(places)) == F.size(found), alone).otherwise(merged).alias("lines")
    )


_MEMBER = ["rel_osm_id", "member_type", "member_osm_id", "member_index"]


def nearest_ways(positions: DataFrame, ways: DataFrame, unit: str = "degree", leaf: int = 4096) -> DataFrame:
    """Foot of every (route, position) on every way of the route within the distance filter.

    Routes of more than `leaf` pairs are joined where a hot route can be split over tasks.
    """
    def feet(p: DataFrame, w: DataFrame) -> DataFrame:
        spots = p.groupBy(*_MEMBER).agg(F.collect_set(F.struct(*_SPOT)).alias("spots"))
        return _hits(spots.join(_lines(w), "rel_osm_id"), [*_MEMBER, "way_index"], unit)

    p, w, busy = _by_size(positions, ways, leaf)
    plain = feet(p.repartition("rel_osm_id"), w.repartition("rel_osm_id"))
    return plain if busy is None else plain.unionByName(feet(*busy))


def _by_size(positions: DataFrame, ways: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Positions and ways with a place, of routes of at most `leaf` pairs of them; and those of all others, if any.

    A route of more than 16 * `leaf` vertices counts as large, too: the lines of all others may sit in one row.
    """
    p = positions.select(*_MEMBER, *_SPOT).filter(F.col("x").isNotNull())
    w = ways.select("rel_osm_id", "index", "geom").filter(F.col("geom").isNotNull())
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sizes = (
        p.select("rel_osm_id", one.alias("p"), none.alias("w"), none.alias("v"))
        .unionByName(w.select("rel_osm_id", none.alias("p"), one.alias("w"), F.size("geom").cast("long").alias("v")))
        .groupBy("rel_osm_id").agg(*[F.sum(c).alias(c) for c in "pwv"])
    )
    # either side alone may be long, too
    large = (F.greatest("p", "w", F.col("p") * F.col("w")) > leaf) | (F.col("v") > 16 * leaf)
    busy = cut_lineage(sizes.filter(large).select("rel_osm_id"))
    if busy.isEmpty():
        return p, w, None
    return (
        p.join(busy, "rel_osm_id", "left_anti"), w.join(busy, "rel_osm_id", "left_anti"),
        (p.join(busy, "rel_osm_id", "left_semi"), w.join(busy, "rel_osm_id", "left_semi")),
    )


def _box(prefix: str, lon_lo: Column, lon_hi: Column, lat_lo: Column, lat_hi: Column) -> list[Column]:
    return [lon_lo.alias(f"{prefix}w"), lon_hi.alias(f"{prefix}e"),
            lat_lo.alias(f"{prefix}s"), lat_hi.alias(f"{prefix}n")]


def _hull_box(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias(f"{p}count"), F.min(f"{p}w").alias(f"{p}w"), F.max(f"{p}e").alias(f"{p}e"),
        F.min(f"{p}s").alias(f"{p}s"), F.max(f"{p}n").alias(f"{p}n"),
    )


_LEVELS = 32  # 360 / 2^32 degrees is below the 1e-7 step of OSM coordinates


def _quadrant(df: DataFrame, p: str, level: int) -> DataFrame:
    """Cell of a box's south-west corner at this level, and the cell above it."""
    scale = 2.0**level / 360.0
    return (
        df.withColumn(f"{p}cx", F.floor((F.col(f"{p}w") + 180) * scale))
        .withColumn(f"{p}cy", F.floor((F.col(f"{p}s") + 180) * scale))
    )


def projected_feet(positions: DataFrame, ways: DataFrame, unit: str = "degree", leaf: int = 4096) -> DataFrame:
    """Foot of every (route, position) on the nearest way of its route within the distance filter.

    Routes of at most `leaf` pairs of positions and ways are compared where their rows meet, after one shuffle by route;
    all others go through quadrants.  The result does not depend on `leaf`.
    """
    p, w, busy = _by_size(positions, ways, leaf)
    plain = _plain_feet(p, w, unit)
    return plain if busy is None else plain.unionByName(_quadrant_feet(*busy, unit, leaf))


def _plain_feet(positions: DataFrame, ways: DataFrame, unit: str) -> DataFrame:
    """Nearest feet of routes whose positions and ways meet whole.

    Rows are dealt by route once, vertices as they are stored.  The ways of a route, bounded by `_by_size`, sit in one row
    that meets its positions one at a time; nothing is multiplied.
    """
    spot = {c: F.col(c) for c in _SPOT}

    def hit(line: Column) -> Column:
        return geo.let(_foot(spot, line["segments"]), lambda f: F.struct(
            _dist(spot, f).alias("dist"), line["way_index"].alias("way_index"), f["fx"].alias("fx"), f["fy"].alias("fy")
        ))

    near = F.array_min(F.filter(F.transform("lines", hit), lambda h: _near(spot, h, unit)))
    found = positions.repartition("rel_osm_id").join(_route_lines(ways.repartition("rel_osm_id")), "rel_osm_id")
    # unfolded, not filtered: a condition would be moved below and the feet worked out again
    return found.select(*_MEMBER, *_SPOT, F.explode(F.array_compact(F.array(near))).alias("m")).select(
        *_MEMBER, *_SPOT, "m.way_index", "m.dist", "m.fx", "m.fy"
    )


def _quadrant_feet(positions: DataFrame, ways: DataFrame, unit: str, leaf: int) -> DataFrame:
    """Nearest feet by quadrants, for routes of any size.

    Stops and ways are sorted into quadrants, level by level.  For a quadrant of stops, a quadrant
    of ways further off than the surest hit of another one cannot hold the nearest way and is
    dropped.  Pairs of quadrants that hold at most `leaf` pairs of elements are compared exactly, all
    others are quartered.
    """
    spots = cut_lineage(
        positions.select("rel_osm_id", "x", "y", "lon", "lat").distinct()
        .select("*", F.struct(*_SPOT).alias("spot"),
                *_box("p_", F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat")))
    )
    lons = F.transform("geom", lambda g: g["lon"])
    lats = F.transform("geom", lambda g: g["lat"])
    lines = cut_lineage(
        # of several ways with one geometry the first one wins every tie
        _with_segments(ways).groupBy("rel_osm_id", "geom", "segments").agg(F.min("way_index").alias("way_index"))
        .select("rel_osm_id", "way_index", "segments",
                *_box("w_", F.array_min(lons), F.array_max(lons), F.array_min(lats), F.array_max(lats)))
        .groupBy("rel_osm_id", "way_index").agg(
            F.flatten(F.collect_list("segments")).alias("segments"),
            *_box("w_", F.min("w_w"), F.max("w_e"), F.min("w_s"), F.max("w_n")),
        )
    )
    gap_x = F.greatest(F.lit(0.0), F.col("w_w") - F.col("p_e"), F.col("p_w") - F.col("w_e"))
    gap_y = F.greatest(F.lit(0.0), F.col("w_s") - F.col("p_n"), F.col("p_s") - F.col("w_n"))
    far_x = F.greatest(F.col("w_e") - F.col("p_w"), F.col("p_e") - F.col("w_w"))
    far_y = F.greatest(F.col("w_n") - F.col("p_s"), F.col("p_n") - F.col("w_s"))
    slack = 2 * 10.0**-_TIE
    todo, feet = None, []
    start = 4
    for level in range(start, _LEVELS + 1):
        p = _quadrant(spots, "p_", level)
        w = _quadrant(lines, "w_", level)
        p_keys, w_keys = ["rel_osm_id", "p_cx", "p_cy"], ["rel_osm_id", "w_cx", "w_cy"]
        p_cells, w_cells = _hull_box(p, p_keys, "p_"), _hull_box(w, w_keys, "w_")
        if todo is None:
            pairs = p_cells.join(w_cells, "rel_osm_id")
        else:
            pairs = (
                todo.join(p_cells.withColumn("up_x", F.floor(F.col("p_cx") / 2))
                          .withColumn("up_y", F.floor(F.col("p_cy") / 2)), ["rel_osm_id", "up_x", "up_y"])
                .join(w_cells.withColumn("uw_x", F.floor(F.col("w_cx") / 2))
                      .withColumn("uw_y", F.floor(F.col("w_cy") / 2)), ["rel_osm_id", "uw_x", "uw_y"])
            )
        pairs = pairs.withColumn("lo", F.sqrt(gap_x * gap_x + gap_y * gap_y)).withColumn(
            "hi", F.sqrt(far_x * far_x + far_y * far_y)
        )
        if unit == "degree":
            sure = pairs.groupBy(*p_keys).agg(F.min("hi").alias("sure"))
            pairs = pairs.join(sure, p_keys).filter(F.col("lo") <= F.col("sure") + slack)
        else:
            far_lat = F.greatest(F.abs("p_n"), F.abs("p_s"), F.abs("w_n"), F.abs("w_s"))
            pairs = pairs.filter(
                F.col("lo") * F.greatest(F.cos(F.radians(far_lat)), F.lit(1e-3)) * 110000 <= MAX_DISTANCE
            )
        pairs = cut_lineage(
            pairs.select("rel_osm_id", "p_cx", "p_cy", "w_cx", "w_cy", "p_count", "w_count")
        )
        again = (F.col("p_count") * F.col("w_count") > leaf) & F.lit(level < _LEVELS)
        small = pairs.filter(~again).select("rel_osm_id", "p_cx", "p_cy", "w_cx", "w_cy")
        joined = small.join(p, p_keys).join(w, w_keys)
        feet.append(_hits(joined.withColumn("spots", F.array("spot")), ["rel_osm_id", "way_index"], unit))
        more = pairs.filter(again)
        if more.isEmpty():
            break
        todo = more.select(
            "rel_osm_id", F.col("p_cx").alias("up_x"), F.col("p_cy").alias("up_y"),
            F.col("w_cx").alias("uw_x"), F.col("w_cy").alias("uw_y"),
        )
    out = feet[0]
    for f in feet[1:]:
        out = out.unionByName(f)
    best = out.groupBy("rel_osm_id", *_SPOT).agg(
        F.min(F.struct("dist", "way_index", "fx", "fy")).alias("m")
    )
    return positions.select(*_MEMBER, *_SPOT).join(best, ["rel_osm_id", *_SPOT]).select(
        *_MEMBER, *_SPOT, "m.way_index", "m.dist", "m.fx", "m.fy"
    )


def best_projection(feet: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """One projected point per route and stop name: (rel_osm_id, stop_key, dist, x, y).

    Only a NULL name falls back to the element's label: stops named '' of a route share one point.
    """
    named = stops.select(
        F.col("osm_type").alias("member_type"), F.col("osm_id").alias("member_osm_id"), "name"
    )
    known = routes.select(F.col("osm_id").alias("rel_osm_id"))
    # one row per member before the stop names are looked up
    per_member = feet.groupBy("rel_osm_id", "member_type", "member_osm_id").agg(
        F.min(F.struct("dist", "member_index", "way_index", "fx", "fy")).alias("m")
    )
    return (
        per_member.join(known, "rel_osm_id")
        .join(named, ["member_type", "member_osm_id"], "left")
        .withColumn(
            "stop_key",
            F.coalesce("name", element_label(F.col("member_type"), F.col("member_osm_id"))),
        )
        .groupBy("rel_osm_id", "stop_key")
        .agg(F.min("m").alias("m"))
        .select(
            "rel_osm_id", "stop_key", "m.dist",
            F.round("m.fx", _GRID).alias("x"), F.round("m.fy", _GRID).alias("y"),
        )
    )


def position_points(best: DataFrame) -> DataFrame:
    """d_routes_position: each projected point once, numbered by its place, with the number of routes that stop there."""
    visits = best.select("rel_osm_id", "x", "y").distinct()
    points = visits.groupBy("x", "y").agg(F.count("*").cast("int").alias("number_of_routes"))
    return ids.numbered(points, ["x", "y"]).select("id", "x", "y", "number_of_routes")


def route_stop_positions(best: DataFrame, points: DataFrame) -> DataFrame:
    """d_route_stop_positions: distinct (route_osm_id, pos, x, y)."""
    visits = best.select(F.col("rel_osm_id").alias("route_osm_id"), "x", "y").distinct()
    return visits.join(points.select(F.col("id").alias("pos"), "x", "y"), ["x", "y"]).select("route_osm_id", "pos", "x", "y")


def positions_by_route(rows: DataFrame) -> DataFrame:
    """d_routes_position_ids (bounded by the 32,000 members a relation may have)."""
    return rows.groupBy(F.col("route_osm_id").alias("rel_osm_id")).agg(
        F.sort_array(F.collect_list("pos")).alias("positions_ids")
    )
