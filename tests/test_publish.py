"""Versions, static export and agreement of stored with lazy tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from busnet.operators import publication, tiles
from busnet.plans.network import TABLES, Network
from busnet.plans.publish import Store, build_all, export_static
from tests.small import SmallFeatures, at


def test_three_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.table("i_x")
    for v in ("v1", "v2", "v3"):
        store.write(v, "i_x", spark.range(1).selectExpr(f"'{v}' AS v"))
        store.publish(v)
    assert store.table("i_x").first()["v"] == "v3"
    assert store.table("i_x", backup=True).first()["v"] == "v2"
    assert not (tmp_path / "versions" / "v1").exists()


def test_builders_at_once(spark, tmp_path):
    """Every version of several builders is published once, and all readers agree on the last."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, str(tmp_path))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(store.publish, [f"v{i}" for i in range(24)]))
    order = store._published()
    assert sorted(v for _, v in order) == sorted(f"v{i}" for i in range(24))
    assert [s for s, _ in order] == sorted(s for s, _ in order)
    seq, current, previous = Store(spark, str(tmp_path)).pointer()
    assert (seq, current) == order[-1] and previous == order[-2][1]
    store.write("last", "i_x", spark.range(3))
    store.publish("last")
    assert store.pointer()[1] == "last" and store.table("i_x").count() == 3


@pytest.fixture
def many_files(spark):
    """Small tables stay in several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def ranges(folder, column):
    """(least, greatest) of a column in each file."""
    import pyarrow.parquet as pq

    found = []
    for f in folder.glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        if stats:
            found.append((min(s.min for s in stats), max(s.max for s in stats)))
    return found


def test_a_lookup_reads_one_file(spark, tmp_path, many_files):
    store = Store(spark, str(tmp_path))
    rows = spark.range(40000).selectExpr("id * 7919 % 40009 AS osm_id", "id AS v").repartition(16)
    read = store.write("v1", "d_routes", rows)
    files = ranges(tmp_path / "versions" / "v1" / "d_routes", "osm_id")
    assert len(files) > 4
    for i in (0, 7919, 20011):
        assert sum(lo <= i <= hi for lo, hi in files) == 1
        assert read.filter(F.col("osm_id") == i).count() == rows.filter(F.col("osm_id") == i).count()
    # a stop that has half of all rows is spread over files
    hot = spark.range(40000).selectExpr("IF(id % 2 = 0, 5, id) AS osm_id", "0 AS osm_type", "id AS rel_osm_id")
    store.write("v1", "d_routes_at_stop", hot)
    files = ranges(tmp_path / "versions" / "v1" / "d_routes_at_stop", "osm_id")
    assert sum(lo <= 5 <= hi for lo, hi in files) >= 3 and sum(lo <= 30001 <= hi for lo, hi in files) == 1


def test_an_extent_reads_few_files(spark, tmp_path, many_files):
    square = spark.range(1 << 14).selectExpr(
        "'ways' AS layer", "13 AS z", "CAST(4000 + id % 128 AS INT) AS x_tile", "CAST(2900 + id DIV 128 AS INT) AS y_tile", "id AS features"
    ).repartition(8)
    path = str(tmp_path / "store")
    publication.store_tiles(square, path)
    n = 1 << 13
    lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n))))
    files = ranges(tmp_path / "store", "curve")
    assert len(files) == 8
    for x, y, w, h in ((4010, 2905, 3, 2), (4100, 3000, 1, 1), (4040, 2960, 10, 10), (3990, 2890, 200, 200)):
        extent = ((x + 0.5) / n * 360 - 180, lat(y + h - 0.5), (x + w - 0.5) / n * 360 - 180, lat(y + 0.5))
        found = {(r.x_tile, r.y_tile) for r in publication.tiles_in(spark, path, "ways", 13, extent).collect()}
        assert found == {(a, b) for a in range(x, x + w) for b in range(y, y + h) if 4000 <= a < 4128 and 2900 <= b < 3028}
        parts = tiles.curve_ranges(*tiles.tile_box(13, extent))
        touched = sum(any(a <= hi and lo <= b for a, b in parts) for lo, hi in files)
        assert touched <= 3 or w == 200
    assert publication.tiles_in(spark, path, "stops", 13, tiles.WORLD).count() == 0
    assert publication.tiles_in(spark, path, "ways", 12, tiles.WORLD).count() == 0


def test_build_and_export(spark, tmp_path):
    f = SmallFeatures(
        spark,
        nodes={1: ("A", at(0, 0)), 2: ("A", at(0, 300)), 3: ("B", at(0, 900))},
        streets={50: [at(5, -10), at(5, 500)], 51: [at(5, 500), at(5, 1000)]},
        routes=[(7, "7", "red"), (8, "8", None)],
        members=[(7, 0, "stop", 0, 1), (7, 1, "stop", 0, 2), (7, 2, "stop", 0, 3), (7, 3, "", 1, 50),
                 (7, 4, "", 1, 51), (8, 0, "stop", 0, 3)],
    )
    store = build_all(spark, f, str(tmp_path / "store"))
    lazy = Network(f)
    for name in TABLES:
        stored = store.table(name)
        assert stored.columns == getattr(lazy, name).columns, name
    assert store.table("d_ways").count() == 1
    assert store.table("d_stops_cluster").count() == 2
    assert store.table("d_route_stop_positions").count() == 2
    _, version, _ = store.pointer()
    kept = {p.name for p in (tmp_path / "store" / "versions" / version).iterdir()}
    assert kept == set(TABLES)

    out = tmp_path / "static"
    export_static(store, str(out), parts=2, zooms=[11, 14])
    assert sorted((out / "ids" / "kind=route").glob("*.txt"))
    routes = [json.loads(line) for p in (out / "routes").rglob("*.json") for line in p.open()]
    assert {r["osm_id"] for r in routes} == {7, 8}
    seven = next(r for r in routes if r["osm_id"] == 7)
    assert seven["geometry"]["type"] == "GeometryCollection" and len(seven["stop_positions"]["geometries"]) == 2
    assert next(r for r in routes if r["osm_id"] == 8)["geometry"] is None
    stops = [json.loads(line) for p in (out / "stops").rglob("*.json") for line in p.open()]
    assert len(stops) == 3
    layers = {p.name for p in (out / "tiles").iterdir() if p.is_dir()}
    assert {"layer=stops", "layer=ways", "layer=routes_position", "layer=stops_shield"} <= layers
