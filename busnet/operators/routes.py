"""Route statistics and path members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from busnet.functions import geo
from busnet.functions.hull import circle_diameter_udf, hull_udf
from busnet.functions.tags import NODE, WAY

MIN_SPACING = 10  # metres; closer stops count as one
# keys of a route's document (fixed values)
ROUTE_COLUMNS = ["osm_id", "ref", "name", "network", "operator", "origin", "destination", "colour"]

# A route is cut into blocks of 2^12 member indexes, so a block holds at most 4,096 members, however
# long the route is.
_BLOCK_BITS = 12


def is_stop_role(role: Column) -> Column:
    return role.contains("stop")


def is_position_role(role: Column) -> Column:
    return role.contains("stop") | role.contains("platform")


def path_members(members: DataFrame) -> DataFrame:
    """Way members that are the route's path.  A NULL role is dropped, '' is kept."""
    role = F.col("member_role")
    return members.filter(
        (F.col("member_type") == WAY) & ~role.contains("stop") & ~role.contains("platform")
    )


def route_ways(members: DataFrame) -> DataFrame:
    """i_ways: the path members with their line."""
    return path_members(members).select("rel_osm_id", F.col("member_index").alias("index"), "geom")


def position_refs(members: DataFrame) -> DataFrame:
    """Stop and platform members (nodes and ways only), without geometry."""
    return members.filter(
        F.col("member_type").isin(NODE, WAY) & is_position_role(F.col("member_role"))
    ).select("rel_osm_id", "member_type", "member_osm_id", "member_index")


def route_positions(members: DataFrame) -> DataFrame:
    """i_positions: stop and platform members at their centroid."""
    chosen = members.filter(
        F.col("member_type").isin(NODE, WAY) & is_position_role(F.col("member_role"))
    )
    return with_centroid(chosen).select(
        "rel_osm_id", "member_type", "member_osm_id", "member_index", "x", "y", "lon", "lat"
    )


def with_centroid(df: DataFrame, centroid: Column | None = None) -> DataFrame:
    """Add x, y, lon, lat of the centroid; a point keeps its own lon/lat exactly."""
    single = F.size("geom") == 1
    if centroid is None:
        centroid = geo.line_centroid(F.col("geom"))
    return (
        df.withColumn("_c", centroid)
        .withColumn("x", F.col("_c.x"))
        .withColumn("y", F.col("_c.y"))
        .withColumn("lon", F.when(single, F.col("geom")[0]["lon"]).otherwise(geo.lon_of(F.col("x"))))
        .withColumn("lat", F.when(single, F.col("geom")[0]["lat"]).otherwise(geo.lat_of(F.col("y"))))
        .drop("_c")
    )


def _spacing_blocks(members: DataFrame, block_bits: int) -> DataFrame:
    """(rel_osm_id, block, stops): stop-role members in order, each with the metres from the one before.

    A member without geometry (a relation, or not in the extract) keeps its place: its own distance
    and that of the next stop are NULL.
    """
    stops = with_centroid(members.filter(is_stop_role(F.col("member_role"))))
    blocks = (
        stops.withColumn("block", F.shiftright("member_index", block_bits))
        .groupBy("rel_osm_id", "block")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("member_index", "member_type", "member_osm_id", "lon", "lat", "geom")
                )
            ).alias("stops")
        )
    )
    # the stop before a block's first one is the last stop of the route's previous block; only routes with a member
    # beyond the first block have one
    long = stops.filter(~F.shiftright("member_index", block_bits).eqNullSafe(0)).select("rel_osm_id").distinct()
    last = F.element_at("stops", -1)
    before = (
        blocks.join(long, "rel_osm_id", "left_semi").select("rel_osm_id", "block", geo.point(last["lon"], last["lat"]).alias("last"))
        .withColumn("before", F.lag("last").over(Window.partitionBy("rel_osm_id").orderBy("block")))
        .filter(F.col("before").isNotNull())
        .select("rel_osm_id", "block", "before")
    )

    def step(p: Column, i: Column) -> Column:
        # the very first stop of a route is measured against itself
        prev = F.when(i > 0, geo.point(F.get("stops", i - 1)["lon"], F.get("stops", i - 1)["lat"])).otherwise(
            F.coalesce("before", geo.point(p["lon"], p["lat"]))
        )
        return F.struct(
            p["member_index"].alias("member_index"),
            geo.spheroid_distance(p["lon"], p["lat"], prev["lon"], prev["lat"]).alias("distance"),
            p["geom"].alias("geom"),
        )

    return blocks.join(before, ["rel_osm_id", "block"], "left").select(
        "rel_osm_id", "block", F.transform("stops", step).alias("stops")
    )


def stop_spacing(members: DataFrame, block_bits: int = _BLOCK_BITS) -> DataFrame:
    """Metres from the previous stop of the route, one row per stop-role member."""
    rows = _spacing_blocks(members, block_bits).select("rel_osm_id", F.explode("stops").alias("s"))
    return rows.select("rel_osm_id", "s.member_index", "s.distance")


def route_statistics(members: DataFrame, block_bits: int = _BLOCK_BITS) -> DataFrame:
    """(rel_osm_id, avg_distance, diameter) of routes with at least one spacing over 10 m.

    Blocks are reduced to a sum, a count and the corners of their convex hull before they meet:
    the smallest circle around a route is the smallest circle around those corners.
    """
    kept = F.filter("stops", lambda s: s["distance"] > MIN_SPACING)
    vertices = F.flatten(F.transform("kept", lambda s: s["geom"]))
    per_block = (
        _spacing_blocks(members, block_bits)
        .select("rel_osm_id", kept.alias("kept"))
        .filter(F.size("kept") > 0)
        .select(
            "rel_osm_id",
            F.size("kept").alias("n"),
            F.aggregate("kept", F.lit(0.0), lambda acc, s: acc + s["distance"]).alias("total"),
            hull_udf(F.flatten(F.transform(vertices, geo.lonlat_pair))).alias("hull"),
        )
    )
    # the test on n is always true; it keeps the spacing arrays a column of their own, because
    # an array expression folded into a UDF call is not handed over to Python
    per_route = (
        per_block.groupBy("rel_osm_id")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"),
             F.flatten(F.collect_list("hull")).alias("hull"))
        .filter("n > 0")
        .withColumn("avg_distance", F.col("total") / F.col("n"))
    )
    return per_route.select(
        "rel_osm_id",
        F.bround("avg_distance").cast("int").alias("avg_distance"),
        F.bround(circle_diameter_udf("hull")).cast("int").alias("diameter"),
    )


def routes_internal(routes: DataFrame, members: DataFrame) -> DataFrame:
    """i_routes: the routes with diameter and avg_distance (NULL where nothing was measured)."""
    stats = route_statistics(members).withColumnRenamed("rel_osm_id", "osm_id")
    return routes.join(stats, "osm_id", "left").select(*routes.columns, "diameter", "avg_distance")


def route_paths(routes: DataFrame, ways: DataFrame) -> DataFrame:
    """d_routes: route attributes and the path, a list of lines in member order (NULL if none).

    An OSM relation has at most 32,000 members, which bounds the collected list.
    """
    parts = (
        ways.filter(F.col("geom").isNotNull())
        # lists do not shrink before they are dealt
        .repartition("rel_osm_id")
        .groupBy("rel_osm_id")
        .agg(F.sort_array(F.collect_set(F.struct("index", "geom"))).alias("parts"))
        .select(
            F.col("rel_osm_id").alias("osm_id"),
            F.transform("parts", lambda p: p["geom"]).alias("geom"),
        )
    )
    return routes.select(*ROUTE_COLUMNS).repartition("osm_id").distinct().join(parts, "osm_id", "left")
