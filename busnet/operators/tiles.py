"""Map tile layers: which features a tile shows at each zoom.

A feature is sent to every tile its box meets (two sequences, no spatial join), ranked inside
the tile and cut at the layer's published limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from busnet.functions import geo

TILE_PIXELS = 256
MIN_ZOOM, MAX_ZOOM = 6, 16
WORLD = (-180.0, -85.05112877980659, 180.0, 85.05112877980659)


@dataclass(frozen=True)
class LayerQuery:
    """One zoom range of a layer: its filter, order and limit."""

    minzoom: int
    maxzoom: int
    limit: int
    order: Callable[[], list[Column]]
    condition: str | None = None


@dataclass(frozen=True)
class Layer:
    name: str
    buffer: int  # pixels
    shape: str  # 'point' (x, y columns) or 'line' (geom column)
    properties: tuple[str, ...]
    queries: tuple[LayerQuery, ...] = field(default=())
    key: tuple[str, ...] = ()  # of a line feature


def _asc(*names: str) -> Callable[[], list[Column]]:
    return lambda: [F.col(n).asc_nulls_last() for n in names]


# names, zooms, buffers and limits of the layers (fixed values); where two ranges of one layer
# share a zoom, the one that starts later serves it
STOP_CLUSTERS = Layer(
    "stops", 0, "point",
    ("osm_type_id", "name", "max_diameter", "max_avg_distance", "number_of_routes"),
    (LayerQuery(11, 13, 999, _asc("max_avg_distance", "cluster_key")),),
)
STOPS = Layer(
    "stops", 0, "point",
    ("osm_type", "osm_id", "name", "local_ref", "max_diameter", "max_avg_distance", "number_of_routes"),
    (LayerQuery(14, MAX_ZOOM, 999, _asc("number_of_routes", "osm_type", "osm_id")),),
)
STOP_SHIELDS = Layer(
    "stops_shield", 0, "point", ("osm_type", "osm_id", "i", "ref", "colour"),
    (LayerQuery(14, MAX_ZOOM, 1000, _asc("osm_type", "osm_id", "i")),),
)
STATIONS = Layer(
    "stations", 0, "point", ("name", "has_polygon"),
    (LayerQuery(MIN_ZOOM, MAX_ZOOM, 1000, _asc("osm_type", "osm_id")),),
)
STATION_AREAS = Layer(
    "stations_area", 1, "line", ("name",),
    (LayerQuery(13, MAX_ZOOM, 1000, _asc("osm_type", "osm_id")),),
    ("osm_type", "osm_id"),
)


def _longest() -> list[Column]:
    # lengths are compared in whole millimetres, ties go by id
    return [F.round("length", 3).desc_nulls_last(), *[F.col(c).asc() for c in ("tie_x", "tie_y", "id")]]


WAYS = Layer(
    "ways", 2, "line", ("id", "max_diameter", "number_of_routes", "length"),
    (
        LayerQuery(11, 11, 999, _longest, "max_diameter > 6000 OR number_of_routes > 1"),
        LayerQuery(12, MAX_ZOOM, 999, _longest),
    ),
    ("id",),
)
POSITIONS = Layer(
    "routes_position", 0, "point", ("id",),
    (LayerQuery(14, MAX_ZOOM, 1000, _asc("x", "y")),),
)


Extent = tuple[float, float, float, float]  # west, south, east, north in degrees


def assign_tiles(
    df: DataFrame, box: Sequence[str], zooms: Sequence[int], buffer: int = 0, extent: Extent = WORLD,
) -> DataFrame:
    """Add z, x_tile, y_tile: one row per tile whose box, grown by buffer pixels, meets the feature's.

    box names the feature's west, south, east and north in Web Mercator metres.  Tiles are
    half-open: a spot on a tile border belongs to the tile east and south of it.  Only tiles that
    meet the extent appear.
    """
    west, south, east, north = box
    half = geo.HALF_WORLD

    def x(lon: float) -> float:
        return math.radians(lon) * geo.A + half

    def y(lat: float) -> float:
        lat = max(WORLD[1], min(WORLD[3], lat))
        return half - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * geo.A

    grow = f"tile_size * {buffer / TILE_PIXELS!r}D"
    sized = (
        df.selectExpr("*", f"explode(array({', '.join(map(str, zooms))})) AS z")
        .selectExpr("*", "shiftleft(1, z) AS n_tiles")
        .selectExpr("*", f"{2 * half!r}D / n_tiles AS tile_size")
        .selectExpr(
            "*",
            f"floor({x(extent[0])!r}D / tile_size) AS first_x", f"floor({x(extent[2])!r}D / tile_size) AS last_x",
            f"floor({y(extent[3])!r}D / tile_size) AS first_y", f"floor({y(extent[1])!r}D / tile_size) AS last_y",
        )
    )

    def span(lo: str, hi: str, axis: str) -> str:
        # the far border of the map belongs to the last tile
        start = f"CAST(greatest(0, first_{axis}, least(n_tiles - 1, floor(({lo}) / tile_size))) AS INT)"
        stop = f"CAST(least(n_tiles - 1, last_{axis}, floor(({hi}) / tile_size)) AS INT)"
        return f"explode(IF({start} <= {stop}, sequence({start}, {stop}), CAST(array() AS ARRAY<INT>))) AS {axis}_tile"

    return (
        sized.selectExpr("*", span(f"{west} - {grow} + {half!r}D", f"{east} + {grow} + {half!r}D", "x"))
        .selectExpr("*", span(f"{half!r}D - {north} - {grow}", f"{half!r}D - {south} + {grow}", "y"))
        .drop("n_tiles", "tile_size", "first_x", "last_x", "first_y", "last_y")
    )


def layer_rows(
    df: DataFrame, layer: Layer, query: LayerQuery, zooms: Sequence[int] | None = None,
    extent: Extent = WORLD,
) -> DataFrame:
    """The features of every tile of one zoom range, ranked from 1 within (z, x_tile, y_tile).

    Lines are ranked without their vertices, which are joined to what the limit leaves.
    """
    served = [z for z in (zooms or range(MIN_ZOOM, MAX_ZOOM + 1)) if query.minzoom <= z <= query.maxzoom]
    rows = df if query.condition is None else df.filter(query.condition)
    box = ["x", "y", "x", "y"]
    if layer.shape == "line":
        box = ["_west", "_south", "_east", "_north"]
        rows = rows.withColumn("_pts", geo.planar(F.col("geom"))).selectExpr(
            "*",
            "array_min(transform(_pts, p -> p.x)) AS _west", "array_min(transform(_pts, p -> p.y)) AS _south",
            "array_max(transform(_pts, p -> p.x)) AS _east", "array_max(transform(_pts, p -> p.y)) AS _north",
            "round(array_min(_pts).x, 3) AS tie_x", "round(array_min(_pts).y, 3) AS tie_y",
        ).drop("_pts", "geom")
    in_tile = Window.partitionBy("z", "x_tile", "y_tile").orderBy(*query.order())
    ranked = (
        assign_tiles(rows, box, served, layer.buffer, extent)
        .withColumn("rank", F.row_number().over(in_tile))
        .filter(F.col("rank") <= query.limit)
        .drop("_west", "_south", "_east", "_north", "tie_x", "tie_y")
    )
    if layer.shape == "line":
        return ranked.join(df.select(*layer.key, "geom"), list(layer.key))
    return ranked


def snap(pts: Column) -> Column:
    """Planar vertices on the pixel grid of the row's tile (z, x_tile, y_tile), repeats dropped."""
    half = F.lit(geo.HALF_WORLD)
    size = half * 2 / F.pow(F.lit(2.0), F.col("z"))
    on_grid = F.transform(
        pts,
        lambda p: F.struct(
            F.floor(((p["x"] + half) / size - F.col("x_tile")) * TILE_PIXELS).cast("int").alias("px"),
            F.floor(((half - p["y"]) / size - F.col("y_tile")) * TILE_PIXELS).cast("int").alias("py"),
        ),
    )
    return geo.let(
        on_grid, lambda g: F.filter(g, lambda p, i: (i == 0) | (p != F.get(g, i - 1)))
    )


def layer_features(rows: DataFrame, layer: Layer) -> DataFrame:
    """(layer, z, x_tile, y_tile, rank, pixels, properties as JSON)."""
    if layer.shape == "point":
        pts = F.array(F.struct(F.col("x"), F.col("y")))
    else:
        pts = geo.planar(F.col("geom"))
    return rows.select(
        F.lit(layer.name).alias("layer"), "z", "x_tile", "y_tile", "rank",
        snap(pts).alias("pixels"),
        F.to_json(F.struct(*layer.properties), {"ignoreNullFields": "false"}).alias("properties"),
    )


def tile_payload(features: DataFrame) -> DataFrame:
    """One row per (layer, tile); the layer limit bounds the list at 1000 features."""
    return features.groupBy("layer", "z", "x_tile", "y_tile").agg(
        F.sort_array(F.collect_list(F.struct("rank", "pixels", "properties"))).alias("features")
    )


# --- a store of tiles that is read by extent --------------------------------------

def curve(x: Column, y: Column) -> Column:
    """Place of a tile on the space-filling curve of its zoom: the bits of x and y in turn."""
    out = F.lit(0).cast("long")
    for i in range(MAX_ZOOM):
        for v, at in ((x, 2 * i), (y, 2 * i + 1)):
            bit = F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, at))
    return out


def curve_ranges(x0: int, x1: int, y0: int, y1: int, most: int = 32) -> list[tuple[int, int]]:
    """Ranges (first, last) of the curve that hold the tiles of a box; quarters are split while there are fewer than most."""
    whole, partial = [], [(MAX_ZOOM, 0, 0, 0)]  # (bits, first place, x, y) of a square
    while partial and len(whole) + len(partial) < most:
        split = []
        for bits, first, x, y in partial:
            half = 1 << (bits - 1)
            for q in range(4):
                a, b = x + half * (q & 1), y + half * (q >> 1)
                square = (bits - 1, first + q * half * half, a, b)
                if a > x1 or b > y1 or a + half <= x0 or b + half <= y0:
                    continue
                inside = a >= x0 and b >= y0 and a + half - 1 <= x1 and b + half - 1 <= y1
                (whole if inside else split).append(square)
        partial = split
    found = []
    for bits, first, _, _ in sorted(whole + partial, key=lambda s: s[1]):
        last = first + (1 << 2 * bits) - 1
        if found and found[-1][1] + 1 == first:
            found[-1] = (found[-1][0], last)
        else:
            found.append((first, last))
    return found


def tile_box(z: int, extent: Extent) -> tuple[int, int, int, int]:
    """First and last x, first and last y of the tiles of a zoom that meet an extent (west, south, east, north)."""
    n = 1 << z

    def at(share: float) -> int:
        return max(0, min(n - 1, math.floor(share * n)))

    def down(lat: float) -> float:
        lat = max(WORLD[1], min(WORLD[3], lat))
        return (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2

    return at((extent[0] + 180) / 360), at((extent[2] + 180) / 360), at(down(extent[3])), at(down(extent[1]))


def in_extent(z: int, extent: Extent) -> Column:
    """Condition on (z, x_tile, y_tile, curve) that Parquet can prune by."""
    x0, x1, y0, y1 = tile_box(z, extent)
    near = F.lit(False)
    for first, last in curve_ranges(x0, x1, y0, y1):
        near = near | F.col("curve").between(first, last)
    return (F.col("z") == z) & near & F.col("x_tile").between(x0, x1) & F.col("y_tile").between(y0, y1)
