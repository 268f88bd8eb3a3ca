"""Routes at a stop, and the other routes a route meets at its stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busnet.functions.tags import falsy, sort_nulls_last

# Shields of a stop as one text: ';' around each, '/' before a colour, none without one; these signs and '~' are escaped.
_ESCAPES = {"~": "~1", "/": "~2", ";": "~3"}


def _escaped(text: Column) -> Column:
    for sign, escape in _ESCAPES.items():
        text = F.replace(text, F.lit(sign), F.lit(escape))
    return text


def _unescaped(text: Column) -> Column:
    for sign, escape in reversed(_ESCAPES.items()):
        text = F.replace(text, F.lit(escape), F.lit(sign))
    return text


def _shield(e: Column) -> Column:
    return F.concat(_escaped(e["ref"]), F.coalesce(F.concat(F.lit("/"), _escaped(e["colour"])), F.lit("")))


def shield_text(found: Column) -> Column:
    """The shields of a list of routes, in its order, as one text; routes with a blank ref have none."""
    marks = F.transform(F.filter(found, lambda r: ~falsy(r["ref"])), _shield)
    return F.concat(F.lit(";"), F.array_join(F.transform(marks, lambda m: F.concat(m, F.lit(";"))), ""))


def shields_of_text(text: Column) -> Column:
    """`shield_text` as the list of (ref, colour) it holds."""
    def listed(plain) -> Column:
        return F.transform(
            F.split(F.substring(text, F.lit(2), F.length(text) - 2), ";"),
            lambda e: F.struct(
                plain(F.substring_index(e, "/", 1)).alias("ref"),
                F.when(F.instr(e, "/") > 0, plain(F.substring_index(e, "/", -1))).alias("colour"),
            ),
        )

    none = F.array().cast("array<struct<ref:string,colour:string>>")
    return F.when(F.length(text) < 2, none).when(text.contains("~"), listed(_unescaped)).otherwise(listed(lambda v: v))


def _without(text: Column, mark: Column) -> Column:
    """text without the first shield `mark`; equal shields of other routes stay."""
    at = F.instr(text, F.concat(F.lit(";"), mark, F.lit(";")))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + F.length(mark) + 2, F.length(text)))).otherwise(text)


def routes_at_stop(stops: DataFrame, positions: DataFrame, routes: DataFrame) -> DataFrame:
    """d_routes_at_stop: one row per visit of a stop by a route, no deduplication."""
    visits = positions.select(
        F.col("member_type").alias("osm_type"), F.col("member_osm_id").alias("osm_id"), "rel_osm_id"
    )
    named = routes.select(
        F.col("osm_id").alias("rel_osm_id"), "transport_mode",
        *[F.col(c).alias(f"rel_{c}") for c in
          ("network", "operator", "ref", "origin", "destination", "colour", "name")],
    )
    return (
        visits.join(stops.select("osm_type", "osm_id"), ["osm_type", "osm_id"])
        .join(named, "rel_osm_id")
        .select(
            "osm_id", "osm_type", "rel_osm_id", "transport_mode", "rel_network", "rel_operator",
            "rel_ref", "rel_origin", "rel_destination", "rel_colour", "rel_name",
        )
    )


def stop_routes(positions: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct (member_type, member_osm_id, rel_osm_id, id, ref, colour): the routes at each stop.

    This row form grows with the visits only; it is what the connection lists are made of.
    `id` stays NULL where the visiting relation is not a known route.
    """
    visits = positions.select("member_type", "member_osm_id", "rel_osm_id").distinct()
    known = routes.select(F.col("osm_id").alias("id"), "ref", "colour")
    return visits.join(known, F.col("rel_osm_id") == F.col("id"), "left").select(
        "member_type", "member_osm_id", "rel_osm_id", "id", "ref", "colour"
    )


def served_stops(positions: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """(member_type, member_osm_id, stop_name, served, strangers): the routes of each stop, ordered by ref, colour and id as
    shields are shown, once under each name of the stop.

    Stops match on the id alone (a node and a way with the same id both give their name).
    """
    entry = F.struct("id", "ref", "colour")
    at_stop = (
        stop_routes(positions, routes)
        # lists do not shrink before they are dealt
        .repartition("member_type", "member_osm_id")
        .groupBy("member_type", "member_osm_id")
        .agg(
            sort_nulls_last(
                F.collect_list(F.when(F.col("id").isNotNull(), entry)), "ref", "colour", "id"
            ).alias("served"),
            F.bool_or(F.col("id").isNull()).alias("strangers"),
        )
    )
    names = stops.select(F.col("osm_id").alias("member_osm_id"), F.col("name").alias("stop_name")).distinct()
    return names.join(at_stop, "member_osm_id").select("member_type", "member_osm_id", "stop_name", "served", "strangers")


def _own(routes: DataFrame) -> DataFrame:
    """(rel_osm_id, copies, mine): how often a route is given, and its shields."""
    # a route stands at each of its stops once for each of its rows; those own shields are taken out of the text of the stop
    mine = F.collect_list(F.when(~falsy(F.col("ref")), _shield(F.struct("ref", "colour"))))
    return routes.repartition("osm_id").groupBy(F.col("osm_id").alias("rel_osm_id")).agg(F.count("*").cast("int").alias("copies"), mine.alias("mine"))


def _stop_of_route(positions: DataFrame) -> list[Column | str]:
    return [
        F.col("rel_osm_id").alias("route_osm_id"),
        F.col("member_osm_id").alias("stop_osm_id"),
        F.col("member_type").alias("stop_osm_type"),
        F.col("member_index").alias("stop_index"),
        "stop_name",
        *[c for c in ("lon", "lat") if c in positions.columns],
    ]


def route_stop_connections(
    positions: DataFrame, stops: DataFrame, routes: DataFrame, lists: bool = True, keep=lambda name, df: df
) -> DataFrame:
    """d_route_stops_with_connections: a route's stops with the other routes found there, and `shields`, their text.

    The routes of a stop are gathered and ordered once
    per stop and the own route is taken out per row, so no pairs of visits are shuffled.  A stop without other routes
    carries one all-NULL entry.

    Without `lists` there is only the text, as documents need it: `keep(name, df)` may store the visits and the texts of the
    stops; a visit meets the text of its stop, the two are dealt by route once, as plain rows, and the own
    shields go where the route's rows lie together.
    """
    if not lists:
        # rows of a stop lie together, which also makes them small
        visits = keep("t_stop_visits", positions.repartition("member_type", "member_osm_id").distinct())
        texts = keep("t_stop_texts", served_stops(visits, stops, routes).withColumn("text", shield_text(F.col("served"))).drop("served", "strangers"))
        return (
            visits.drop("x", "y").join(texts, ["member_type", "member_osm_id"])
            .repartition("rel_osm_id")
            .join(_own(routes), "rel_osm_id")
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
            .select(*_stop_of_route(positions), F.aggregate("mine", F.col("text"), _without).alias("shields"))
        )
    nothing = F.array(
        F.struct(
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("string").alias("colour"),
        )
    )
    other = F.filter("served", lambda r: r["id"] != F.col("rel_osm_id"))
    # relations that are no known route count as one all-NULL entry, like no relation at all
    alone = F.col("strangers") | (F.size("other") == 0)
    return (
        positions.distinct()
        .join(_own(routes), "rel_osm_id")
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        .join(served_stops(positions, stops, routes).withColumn("text", shield_text(F.col("served"))), ["member_type", "member_osm_id"])
        .select(
            *_stop_of_route(positions), "strangers", other.alias("other"),
            F.aggregate("mine", F.col("text"), _without).alias("shields"),
        )
        .withColumn("other_routes_at_stop", F.when(alone, F.concat("other", nothing)).otherwise(F.col("other")))
        .drop("strangers", "other")
    )
