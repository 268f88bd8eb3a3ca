"""The derived network at keys as large as those of scale factor 100 and beyond."""

from pyspark.sql import functions as F

from busnet.functions import geo
from busnet.operators.segments import _fingerprint
from busnet.operators.tiles import assign_tiles
from busnet.sources.fixture import FixtureFeatures


class Large(FixtureFeatures):
    """Tables of a few rows with the keys of very large ones."""

    KEYS = [0, 1, 999, 20_000, 400_000, 1_000_000, 20_000_000, 15_000_000_001, 600_000_000_040]

    def _table(self, name):
        key = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}[name]
        columns = {
            "part": "'n' AS p_name, 'b' AS p_brand, 3 AS p_size", "supplier": "'s' AS s_name", "customer": "'c' AS c_name",
            "orders": "1L AS o_custkey, 'O' AS o_orderstatus, '1' AS o_orderpriority",
        }[name]
        keys = self._spark.createDataFrame([(k + d,) for k in self.KEYS for d in range(45)], f"{key} long")
        return keys.selectExpr(key, *columns.split(", ")).distinct()


def test_coordinates_stay_on_the_map(spark):
    net = Large(spark, "")
    spots = net.way_vertices.select("lon", "lat").unionByName(
        net.nodes_bus_stop.select(F.col("geom")[0]["lon"].alias("lon"), F.col("geom")[0]["lat"].alias("lat"))
    ).unionByName(net.nodes_bus_station.select(F.col("geom")[0]["lon"].alias("lon"), F.col("geom")[0]["lat"].alias("lat")))
    assert spots.filter("lon NOT BETWEEN -180 AND 180 OR lat NOT BETWEEN -85 AND 85").count() == 0
    assert spots.filter(geo.mercator_y(F.col("lat")).isNull() | geo.mercator_x(F.col("lon")).isNull()).count() == 0


def test_way_ids_do_not_meet(spark):
    shared = Large(spark, "").way_vertices.groupBy("way_id", "pos").count().filter("count > 1")
    assert shared.count() == 0


def test_every_customer_is_a_station(spark):
    net = Large(spark, "")
    assert net.nodes_bus_station.count() + net.ways_bus_station.count() == net._table("customer").count()


def test_the_salt_of_an_identity_comes_first(spark):
    """With the salt last, both halves would follow from one 64-bit state."""
    row = spark.range(1).select(*_fingerprint(["a", "b"], F.lit(5))).first()
    plain = spark.sql("SELECT xxhash64(0, 5) AS a, xxhash64(1, 5) AS b").first()
    assert (row.a, row.b) == (plain.a, plain.b) and row.a != row.b


def test_the_far_border_has_a_tile(spark):
    half = geo.HALF_WORLD
    edge = spark.createDataFrame([(half, 0.0), (-half, 0.0)], "x double, y double")
    rows = assign_tiles(edge, ["x", "y", "x", "y"], [3]).select("x", "x_tile").collect()
    assert {(r.x > 0, r.x_tile) for r in rows} == {(True, 7), (False, 0)}
