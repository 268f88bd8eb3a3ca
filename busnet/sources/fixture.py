"""A bus network derived from the order/part/supplier/customer tables (see FIXTURES.md).

Coordinates are whole 1e-7 degrees divided once, so every engine holds the same doubles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql.functions import row_number

from busnet.sources.features import assemble_lines, element_geometry

# the columns read, with their stored types
_TABLES = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT",
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def _geom(lon_e7: str, lat_e7: str) -> str:
    return (
        f"array(named_struct('lon', CAST({lon_e7} AS DOUBLE) / 1e7D, "
        f"'lat', CAST({lat_e7} AS DOUBLE) / 1e7D)) AS geom"
    )


# Each kind of way has an id range of its own that no key of the tables can leave.
_STREET, _RING, _PRIVATE, _CROSS, _INNER, _PART = (k * 10**15 for k in range(1, 7))

# Ends (x0, y0, x1, y1) of the four streets of a crossing, in 1e-7 degrees: the second crosses the first, the third
# begins on it, the fourth overlaps it.
_CROSSING = ((0, 0, 8000, 0), (1000, -3000, 3000, 4000), (6000, 0, 6000, 3500), (5000, 0, 10000, 0))


def _scatter(key: str) -> tuple[str, str]:
    """Pseudo-random spot (lon, lat in 1e-7 degrees) in a small town."""
    return f"20000000 + ({key} * 104729) % 997 * 500", f"450000000 + ({key} * 7919) % 1000 * 400"


def _town(key: str) -> tuple[str, str]:
    """Offset (lon, lat) of the town of 1,000 keys on a grid of 300 by 30 towns, used again beyond that."""
    return f"{key} DIV 30000 % 300 * 5000000", f"{key} DIV 1000 % 30 * 1000000"


def _chain(ways: DataFrame, first_id: int, lat_e7: int) -> DataFrame:
    """Street w joins vertices 2w, 2w+1, 2w+2 of one snake-shaped chain of 40-vertex columns.

    100,000 columns make a band from west to east; the next band lies north of it, 300 in all.
    """
    column = "(2 * w + pos) DIV 40"
    return ways.selectExpr("w", "explode(array(0, 1, 2)) AS pos").selectExpr(
        f"w + {first_id} AS way_id", "pos",
        f"20000000 + {column} % 100000 * 12000 AS lon_e7",
        f"{lat_e7} + {column} DIV 100000 % 300 * 1000000 + 10000 * IF({column} % 2 = 0, "
        "(2 * w + pos) % 40, 39 - (2 * w + pos) % 40) AS lat_e7",
    )


_NO_RINGS = "CAST(array() AS ARRAY<STRUCT<hole: BOOLEAN, geom: ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>>) AS rings"


class FixtureFeatures:
    """The feature tables, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.schema(_TABLES[name]).parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        return assemble_lines(self.way_vertices)

    @cached_property
    def nodes_bus_stop(self) -> DataFrame:
        lon, lat = (f"{spot} + {town}" for spot, town in zip(_scatter("p_partkey"), _town("p_partkey")))
        return self._table("part").selectExpr(
            "p_partkey + 1 AS id", "p_partkey AS osm_id",
            "CASE WHEN p_size % 17 = 0 THEN NULL WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS name",
            "p_size % 2 = 0 AS has_shelter", "p_size % 3 = 0 AS has_bench",
            "p_size % 5 = 0 AS has_tactile_paving", "p_size % 7 = 0 AS has_departures_board",
            "p_size % 4 = 0 AS is_wheelchair_ok", "p_brand AS local_ref",
            "'bus_stop' AS highway", "'platform' AS public_transport",
            _geom(lon, lat),
        )

    @cached_property
    def ways_bus_stop(self) -> DataFrame:
        part = self._table("part").selectExpr("p_partkey AS s_suppkey", "p_name")
        lines = self._lines.withColumnRenamed("way_id", "s_suppkey")
        return self._table("supplier").join(part, "s_suppkey").join(lines, "s_suppkey").selectExpr(
            "s_suppkey + 1 AS id", "s_suppkey AS osm_id", "IF(s_suppkey % 7 = 0, '', p_name) AS name",
            "s_suppkey % 2 = 0 AS has_shelter", "s_suppkey % 3 = 0 AS has_bench",
            "false AS has_tactile_paving", "s_suppkey % 5 = 0 AS has_departures_board",
            "true AS is_wheelchair_ok", "s_name AS local_ref",
            "'bus_stop' AS highway", "'' AS public_transport", "geom",
        )

    @cached_property
    def nodes_bus_station(self) -> DataFrame:
        return self._table("customer").filter("c_custkey % 2 = 1").selectExpr(
            "c_custkey + 1 AS id", "c_custkey AS osm_id", "c_name AS name", "'ST_Point' AS geom_type",
            _geom(*_scatter("c_custkey")), _NO_RINGS,
        )

    @cached_property
    def ways_bus_station(self) -> DataFrame:
        rings = self._table("customer").filter("c_custkey % 2 = 0").selectExpr(
            "c_custkey", "c_name", f"{_RING} + c_custkey AS way_id", "c_custkey % 10 = 4 AS multi"
        )
        more = self._lines.filter(f"way_id >= {_INNER} AND way_id < {_PART + 10**15}").selectExpr(
            f"{_RING} + way_id % {10**15} AS way_id", f"array(named_struct('hole', way_id < {_PART}, 'geom', geom)) AS other"
        )
        return rings.join(self._lines, "way_id").join(more, "way_id", "left").selectExpr(
            "c_custkey + 1 AS id", "IF(multi, -way_id, way_id) AS osm_id", "c_name AS name",
            "IF(multi, 'ST_MultiPolygon', 'ST_Polygon') AS geom_type", "geom",
            f"coalesce(other, {_NO_RINGS.removesuffix(' AS rings')}) AS rings",
        )

    @cached_property
    def relations_route(self) -> DataFrame:
        return self._table("orders").selectExpr(
            "-(o_orderkey + 1) AS osm_id", "concat('Route ', o_orderkey) AS name",
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' "
            "ELSE CAST(o_custkey % 60 AS STRING) END AS ref",
            "o_orderpriority AS network", "concat('Origin ', o_custkey % 10) AS origin",
            "IF(o_custkey % 6 = 0, '', concat('Terminus ', o_custkey % 12)) AS destination",
            "CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'red' ELSE '#00AA55' END AS colour",
            "o_orderstatus AS operator", "'2' AS public_transport_version", "'bus' AS transport_mode",
        )

    @cached_property
    def member_refs(self) -> DataFrame:
        in_order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        )
        rows = self._table("lineitem").withColumn("rn", row_number().over(in_order))
        steps = rows.selectExpr("*", "explode(IF(l_returnflag = 'R', array(0, 1), array(0))) AS j")
        return steps.selectExpr(
            "-(l_orderkey + 1) AS rel_osm_id",
            f"CASE WHEN l_returnflag = 'R' AND l_orderkey % 40 = 0 THEN {_PRIVATE} + 2 * (l_orderkey DIV 40) + j "
            f"WHEN l_returnflag = 'R' AND l_orderkey % 40 = 8 THEN {_CROSS} + 4 * (l_orderkey DIV 40) + (l_linenumber + j) % 4 "
            f"WHEN l_returnflag = 'R' THEN {_STREET} + 2 * l_suppkey + j "
            "WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_suppkey ELSE l_partkey END AS member_osm_id",
            "CAST(rn * 10 + j AS INT) AS member_index",
            "CASE WHEN l_returnflag = 'R' THEN '' "
            "WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'stop' "
            "WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'stop_entry_only' "
            "ELSE 'platform' END AS member_role",
            # a few stops are relations, which have no geometry
            "CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'O') THEN 1 "
            "WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_partkey % 50 = 7 THEN 2 ELSE 0 END AS member_type",
        )

    @cached_property
    def way_vertices(self) -> DataFrame:
        supplier, customer, orders = (self._table(t) for t in ("supplier", "customer", "orders"))
        lon, lat = _scatter("s_suppkey")
        stops = supplier.selectExpr("s_suppkey", "explode(array(0, 1)) AS pos").selectExpr(
            "s_suppkey AS way_id", "pos", f"{lon} + 100 AS lon_e7", f"{lat} + 100 + 900 * pos AS lat_e7"
        )
        lon, lat = _scatter("c_custkey")
        rings = customer.filter("c_custkey % 2 = 0").selectExpr(
            "c_custkey", "explode(array(0, 1, 2, 3, 4)) AS pos"
        ).selectExpr(
            f"{_RING} + c_custkey AS way_id", "pos", f"{lon} + IF(pos IN (1, 2), 4000, 0) AS lon_e7",
            f"{lat} + IF(pos IN (2, 3), 3000, 0) AS lat_e7",
        )
        # stations with the last digit 6 have a hole, those with 4 a second part
        more = customer.filter("c_custkey % 10 IN (4, 6)").selectExpr(
            "c_custkey", "c_custkey % 10 = 6 AS hole", "explode(array(0, 1, 2, 3, 4)) AS pos"
        ).selectExpr(
            f"IF(hole, {_INNER}, {_PART}) + c_custkey AS way_id", "pos",
            f"{lon} + IF(hole, 500, 6000) + IF(pos IN (1, 2), IF(hole, 1000, 2000), 0) AS lon_e7",
            f"{lat} + IF(hole, 700, 1000) + IF(pos IN (2, 3), IF(hole, 800, 1500), 0) AS lat_e7",
        )
        streets = _chain(
            supplier.selectExpr("explode(array(2 * s_suppkey, 2 * s_suppkey + 1)) AS w"), _STREET, 450000000
        )
        private = _chain(
            orders.filter("o_orderkey % 40 = 0").selectExpr(
                "explode(array(2 * (o_orderkey DIV 40), 2 * (o_orderkey DIV 40) + 1)) AS w"
            ),
            _PRIVATE, 450450000,
        )
        ends = ", ".join(f"named_struct('k', {k}, 'pos', {pos}, 'x', {e[2 * pos]}, 'y', {e[2 * pos + 1]})" for k, e in enumerate(_CROSSING) for pos in (0, 1))
        crossings = orders.filter("o_orderkey % 40 = 8").selectExpr("o_orderkey DIV 40 AS g", f"explode(array({ends})) AS e").selectExpr(
            f"{_CROSS} + 4 * g + e.k AS way_id", "e.pos AS pos", "20000000 + g % 100000 * 12000 + e.x AS lon_e7",
            "450900000 + g DIV 100000 % 300 * 1000000 + e.y AS lat_e7",
        )
        vertices = streets.unionByName(private).unionByName(stops).unionByName(rings).unionByName(more).unionByName(crossings)
        return vertices.selectExpr(
            "way_id", "pos", "CAST(lon_e7 AS DOUBLE) / 1e7D AS lon", "CAST(lat_e7 AS DOUBLE) / 1e7D AS lat"
        )

    @cached_property
    def element_geometry(self) -> DataFrame:
        return element_geometry(self.nodes_bus_stop, self._lines)
