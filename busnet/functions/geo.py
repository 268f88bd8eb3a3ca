"""Geometry as Column expressions.

A geometry is an array of (lon, lat) structs: one vertex for a point, several for a line,
a closed sequence for a ring.  Planar work happens in Web Mercator metres (x, y).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# WGS 84 and the spherical radius of Web Mercator (fixed values)
A = 6378137.0
INV_F = 298.257223563
FLAT = 1.0 / INV_F
E2 = FLAT * (2.0 - FLAT)
ECC = math.sqrt(E2)
HALF_WORLD = math.pi * A


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(A)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(A)


def lon_of(x: Column) -> Column:
    return F.degrees(x / F.lit(A))


def lat_of(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / F.lit(A))) * 2 - F.lit(math.pi / 2))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def planar(geom: Column) -> Column:
    """Vertices in Web Mercator metres."""
    return F.transform(
        geom, lambda p: F.struct(mercator_x(p["lon"]).alias("x"), mercator_y(p["lat"]).alias("y"))
    )


def segments(vertices: Column) -> Column:
    """Consecutive vertex pairs as structs (a, b); empty for a single vertex."""

    def pairs(v: Column) -> Column:
        n = F.size(v)
        return F.zip_with(
            F.slice(v, F.lit(1), n - 1),
            F.slice(v, F.lit(2), n - 1),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )

    return let(vertices, pairs)


def _hypot(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _vertex_mean(pts: Column) -> Column:
    n = F.size(pts)
    return F.struct(
        (_total(F.transform(pts, lambda p: p["x"])) / n).alias("x"),
        (_total(F.transform(pts, lambda p: p["y"])) / n).alias("y"),
    )


def _weighted(acc: Column, w: Column, x: Column, y: Column) -> Column:
    return F.struct(
        (acc["w"] + w).alias("w"), (acc["x"] + w * x).alias("x"), (acc["y"] + w * y).alias("y")
    )


def _no_weight() -> Column:
    return F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


def line_centroid(geom: Column) -> Column:
    """Length-weighted centroid (x, y); a point or a zero-length line gives the vertex mean."""

    def of(pts: Column) -> Column:
        by_length = F.aggregate(
            segments(pts),
            _no_weight(),
            lambda acc, s: let(
                _hypot(s["a"], s["b"]),
                lambda w: _weighted(
                    acc, w, (s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2
                ),
            ),
            lambda acc: F.when(
                acc["w"] > 0,
                F.struct((acc["x"] / acc["w"]).alias("x"), (acc["y"] / acc["w"]).alias("y")),
            ),
        )
        return F.coalesce(by_length, _vertex_mean(pts))

    only = F.struct(mercator_x(geom[0]["lon"]).alias("x"), mercator_y(geom[0]["lat"]).alias("y"))
    return F.when(F.size(geom) == 1, only).when(F.size(geom) > 1, let(planar(geom), of))


def polygon_centroid(geom: Column) -> Column:
    """Area-weighted centroid (x, y) of a closed ring; zero area falls back to the outline's."""

    def of(pts: Column) -> Column:
        x0, y0 = pts[0]["x"], pts[0]["y"]

        def cross(s: Column) -> Column:
            return (s["a"]["x"] - x0) * (s["b"]["y"] - y0) - (s["b"]["x"] - x0) * (s["a"]["y"] - y0)

        return F.aggregate(
            segments(pts),
            _no_weight(),
            lambda acc, s: let(
                cross(s),
                lambda w: _weighted(
                    acc, w, s["a"]["x"] + s["b"]["x"] - x0 * 2, s["a"]["y"] + s["b"]["y"] - y0 * 2
                ),
            ),
            lambda acc: F.when(
                acc["w"] != 0,
                F.struct(
                    (x0 + acc["x"] / (acc["w"] * 3)).alias("x"),
                    (y0 + acc["y"] / (acc["w"] * 3)).alias("y"),
                ),
            ),
        )

    return F.coalesce(let(planar(geom), of), line_centroid(geom))


def rings_centroid(geom: Column, rings: Column) -> Column:
    """Area-weighted centroid (x, y) of a closed ring and further ones (hole, geom); holes count as less.

    Rings may run either way round; without an area it is the centroid of the first ring's outline.
    """
    every = F.concat(F.array(F.struct(F.lit(False).alias("hole"), geom.alias("geom"))), rings)
    flat = F.transform(every, lambda r: F.struct(r["hole"].alias("hole"), planar(r["geom"]).alias("pts")))

    def of(all_rings: Column) -> Column:
        x0, y0 = all_rings[0]["pts"][0]["x"], all_rings[0]["pts"][0]["y"]

        def moments(ring: Column) -> Column:
            def cross(s: Column) -> Column:
                return (s["a"]["x"] - x0) * (s["b"]["y"] - y0) - (s["b"]["x"] - x0) * (s["a"]["y"] - y0)

            return F.aggregate(
                segments(ring["pts"]), _no_weight(),
                lambda acc, s: let(
                    cross(s), lambda w: _weighted(acc, w, s["a"]["x"] + s["b"]["x"] - x0 * 2, s["a"]["y"] + s["b"]["y"] - y0 * 2)
                ),
                lambda acc: let(
                    F.signum(acc["w"]) * F.when(ring["hole"], -1.0).otherwise(1.0),
                    lambda k: F.struct((acc["w"] * k).alias("w"), (acc["x"] * k).alias("x"), (acc["y"] * k).alias("y")),
                ),
            )

        return F.aggregate(
            F.transform(all_rings, moments), _no_weight(),
            lambda acc, m: F.struct((acc["w"] + m["w"]).alias("w"), (acc["x"] + m["x"]).alias("x"), (acc["y"] + m["y"]).alias("y")),
            lambda acc: F.when(
                acc["w"] != 0,
                F.struct((x0 + acc["x"] / (acc["w"] * 3)).alias("x"), (y0 + acc["y"] / (acc["w"] * 3)).alias("y")),
            ),
        )

    return F.coalesce(let(flat, of), line_centroid(geom))


def spheroid_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Geodesic metres on WGS 84: Lambert's first-order correction on reduced latitudes."""

    def square(v: Column) -> Column:
        return v * v

    def reduced(lat: Column) -> Column:
        return F.atan(F.tan(F.radians(lat)) * F.lit(1 - FLAT))

    def haversine(b: Column) -> Column:
        return square(F.sin((b["b2"] - b["b1"]) / 2)) + F.cos(b["b1"]) * F.cos(b["b2"]) * square(
            F.sin(F.radians(lon2 - lon1) / 2)
        )

    def corrected(v: Column) -> Column:
        along = (v["s"] - F.sin(v["s"])) * square(F.sin(v["p"]) * F.cos(v["q"])) / square(F.cos(v["s"] / 2))
        across = (v["s"] + F.sin(v["s"])) * square(F.cos(v["p"]) * F.sin(v["q"])) / square(F.sin(v["s"] / 2))
        return F.lit(A) * (v["s"] - F.lit(FLAT / 2) * (along + across))

    def from_reduced(b: Column) -> Column:
        sigma = F.asin(F.least(F.lit(1.0), F.sqrt(haversine(b)))) * 2
        parts = F.struct(
            ((b["b1"] + b["b2"]) / 2).alias("p"), ((b["b2"] - b["b1"]) / 2).alias("q"), sigma.alias("s")
        )
        return let(parts, corrected)

    dist = let(F.struct(reduced(lat1).alias("b1"), reduced(lat2).alias("b2")), from_reduced)
    return F.when((lon1 == lon2) & (lat1 == lat2), F.lit(0.0)).otherwise(dist)


# --- local metric, used only for "within a few hundred metres" ---------------

def _metres_per_degree(lat: Column) -> Column:
    """(east, north) metres per degree in the tangent plane at lat."""

    def scale(s: Column) -> Column:
        w2 = F.lit(1.0) - s * s * F.lit(E2)
        return F.struct(
            (F.lit(math.radians(A)) * F.cos(F.radians(lat)) / F.sqrt(w2)).alias("e"),
            (F.lit(math.radians(A * (1 - E2))) / (w2 * F.sqrt(w2))).alias("n"),
        )

    return let(F.sin(F.radians(lat)), scale)


def _point_segment(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(
        len2 > 0,
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / len2)),
    ).otherwise(F.lit(0.0))
    return let(
        t, lambda v: F.sqrt((ax + dx * v - px) * (ax + dx * v - px) + (ay + dy * v - py) * (ay + dy * v - py))
    )


def segment_distance(s: dict[str, Column], t: dict[str, Column]) -> Column:
    """Metres between two short segments (each a dict lon1, lat1, lon2, lat2)."""

    def between(v: Column) -> Column:
        ax, ay, bx, by, cx, cy, dx, dy = (v[k] for k in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"))

        def side(px, py, qx, qy, rx, ry):
            return (qx - px) * (ry - py) - (qy - py) * (rx - px)

        crossing = (
            (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0)
            & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
        )
        nearest = F.least(
            _point_segment(ax, ay, cx, cy, dx, dy),
            _point_segment(bx, by, cx, cy, dx, dy),
            _point_segment(cx, cy, ax, ay, bx, by),
            _point_segment(dx, dy, ax, ay, bx, by),
        )
        return F.when(crossing, F.lit(0.0)).otherwise(nearest)

    def in_plane(k: Column) -> Column:
        def at(end: dict[str, Column], i: int, name: str) -> list[Column]:
            return [
                ((end[f"lon{i}"] - s["lon1"]) * k["e"]).alias(f"{name}x"),
                ((end[f"lat{i}"] - s["lat1"]) * k["n"]).alias(f"{name}y"),
            ]

        return let(F.struct(*at(s, 1, "a"), *at(s, 2, "b"), *at(t, 1, "c"), *at(t, 2, "d")), between)

    return let(_metres_per_degree((s["lat1"] + s["lat2"] + t["lat1"] + t["lat2"]) / 4), in_plane)


# --- output -----------------------------------------------------------------

def lonlat_pair(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def geojson_point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def geojson_line(geom: Column) -> Column:
    return F.struct(
        F.lit("LineString").alias("type"), F.transform(geom, lonlat_pair).alias("coordinates")
    )
