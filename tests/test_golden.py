"""Small hand-made networks with known answers."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from busnet.functions import geo
from busnet.functions.hull import enclosing_circle
from busnet.functions.tags import element_code, sort_nulls_last
from busnet.operators import documents, positions, routes, stops, tiles
from busnet.operators.graph import connected_components
from busnet.plans.network import Network
from tests.small import SmallFeatures, at


def along(spark, *metres, role="stop"):
    """One route with stops so many metres north of the start."""
    f = SmallFeatures(spark, routes=[(1, "1", "red")])
    for i, m in enumerate(metres):
        f.nodes[i + 1] = (f"s{i}", at(0, m))
        f.members.append((1, i, role, 0, i + 1))
    return Network(f)


def test_distance_is_geodesic(spark):
    # Flinders Peak - Buninyong, the textbook pair
    d = spark.range(1).select(
        geo.spheroid_distance(F.lit(144.42486789), F.lit(-37.95103342), F.lit(143.92649553), F.lit(-37.65282114))
    ).first()[0]
    assert d == pytest.approx(54972.271, abs=0.1)


@pytest.mark.parametrize("bits", [18, 1, 0])
def test_spacing_does_not_depend_on_blocks(spark, bits):
    net = along(spark, 0, 500, 1500, 1600)
    rows = routes.stop_spacing(net.members, bits).orderBy("member_index").collect()
    assert [round(r["distance"]) for r in rows] == [0, 500, 1000, 100]
    stat = routes.route_statistics(net.members, bits).first()
    assert (stat["avg_distance"], stat["diameter"]) == (533, pytest.approx(1100, abs=250))


def test_one_stop_has_no_statistics(spark):
    assert routes.route_statistics(along(spark, 0).members).count() == 0
    row = along(spark, 0).i_routes.first()
    assert row["diameter"] is None and row["avg_distance"] is None


def test_two_stops_leave_one_point(spark):
    row = along(spark, 0, 500).i_routes.first()
    assert (row["avg_distance"], row["diameter"]) == (500, 0)


def test_near_duplicate_is_dropped(spark):
    assert routes.route_statistics(along(spark, 0, 5).members).count() == 0


def test_rounding_is_half_even(spark):
    got = spark.createDataFrame([(2.5,), (3.5,)], "v double").select(F.bround("v").cast("int")).collect()
    assert [r[0] for r in got] == [2, 4]


def test_circle_matches_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 40, 500):
        pts = rng.normal(size=(n, 2))
        cx, cy, r = enclosing_circle(pts)
        gap = np.hypot(*(pts - [cx, cy]).T) - r
        assert gap.max() <= 1e-9
        assert (gap > -1e-9).sum() >= min(n, 2) or n == 1


def test_circle_of_repeated_and_collinear_points():
    assert enclosing_circle(np.zeros((5, 2))) == (0.0, 0.0, 0.0)
    assert enclosing_circle(np.array([[0, 0], [1, 0], [4, 0]], float)) == (2.0, 0.0, 2.0)


# --- clusters -------------------------------------------------------------------

def clusters(spark, nodes=None, ways=None, leaf=10_000):
    f = SmallFeatures(spark, nodes=nodes or {}, stop_ways=ways or {})
    shaped = Network(f).stops_with_shape
    found: dict = {}
    for r in stops.cluster_members(shaped, leaf).collect():
        found.setdefault(r["cluster_id"], []).append((r["osm_type"], r["osm_id"]))
    return sorted(sorted(v) for v in found.values())


def test_chain_is_one_cluster(spark):
    nodes = {i: ("A", at(300 * i, 0)) for i in range(1, 4)}
    assert clusters(spark, nodes) == [[(0, 1), (0, 2), (0, 3)]]


def test_names_split(spark):
    assert len(clusters(spark, {1: ("A", at(0, 0)), 2: ("B", at(10, 0))})) == 2


def test_reach_is_400_metres(spark):
    assert len(clusters(spark, {1: ("A", at(0, 0)), 2: ("A", at(0, 399))})) == 1
    assert len(clusters(spark, {1: ("A", at(0, 0)), 2: ("A", at(0, 401))})) == 2


def test_unnamed_stand_alone(spark):
    assert len(clusters(spark, {1: ("", at(0, 0)), 2: ("", at(1, 0)), 3: (None, at(0, 1))})) == 3


def test_way_far_from_its_centroid_is_left_out(spark):
    ring = [at(500 * np.cos(a), 500 * np.sin(a)) for a in np.linspace(0, 2 * np.pi, 25)]
    ring = [(float(x), float(y)) for x, y in ring]
    assert clusters(spark, ways={1: ("A", ring)}) == []
    # unless another stop of its name stands there
    both = clusters(spark, {7: ("A", at(0, 0))}, {1: ("A", ring)})
    assert both == [[(0, 7), (1, 1)]]


def test_clusters_equal_brute_force_however_crowded(spark):
    rng = np.random.default_rng(7)
    spots = rng.uniform(0, 2500, size=(160, 2))
    spots[:40] = rng.uniform(0, 60, size=(40, 2))  # crowded corner
    spots[40:80] = [430, 0] + rng.uniform(0, 60, size=(40, 2))  # crowded, about 400 m away
    xy = {i + 1: at(*map(float, p)) for i, p in enumerate(spots)}
    metres = np.array([[(lon - 2) / (1 / 78846.8), (lat - 45) / (1 / 111131.7)] for lon, lat in xy.values()])
    near = np.hypot(*(metres[:, None] - metres[None]).transpose(2, 0, 1)) <= 400
    label = np.arange(len(metres))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    expected = sorted(sorted((0, int(i) + 1) for i in np.flatnonzero(label == c)) for c in set(label))
    nodes = {i: ("A", p) for i, p in xy.items()}
    assert clusters(spark, nodes) == expected
    assert clusters(spark, nodes, leaf=2) == expected


# --- segments -------------------------------------------------------------------

def lines(spark, streets, used):
    """Merged lines of streets {id: vertices}; used {route: [street ids]}."""
    f = SmallFeatures(spark, streets=streets, routes=[(r, str(r), "") for r in used])
    for r, ids in used.items():
        f.members += [(r, i, "", 1, s) for i, s in enumerate(ids)]
    rows = Network(f).d_ways.collect()
    return sorted((r["number_of_routes"], [(p["lon"], p["lat"]) for p in r["geom"]]) for r in rows)


A, B, C, D = (0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (1.0, 1.0)


def test_lines_merge(spark):
    assert lines(spark, {1: [A, B], 2: [B, C]}, {1: [1, 2]}) == [(1, [A, B, C])]


def test_junction_splits(spark):
    assert len(lines(spark, {1: [A, B], 2: [B, C], 3: [B, D]}, {1: [1, 2, 3]})) == 3


def test_ring_is_one_closed_line(spark):
    [(_, ring)] = lines(spark, {1: [A, B, D, A]}, {1: [1]})
    assert ring[0] == ring[-1] and len(ring) == 4


def test_repeated_street_counts_once(spark):
    assert lines(spark, {1: [A, B], 2: [A, B], 3: [B, A]}, {1: [1, 2, 3]}) == [(1, [A, B])]


def test_other_route_set_is_other_line(spark):
    assert lines(spark, {1: [A, B], 2: [B, C]}, {1: [1, 2], 2: [2]}) == [(1, [A, B]), (2, [B, C])]


def test_crossing_without_shared_vertex(spark):
    mid = (1.0, 1.0)
    got = lines(spark, {1: [A, (2.0, 2.0)], 2: [C, (0.0, 2.0)]}, {1: [1, 2]})
    assert got == sorted((1, sorted([end, mid])) for end in (A, C, (0.0, 2.0), (2.0, 2.0)))


def test_streets_of_other_routes_are_not_split(spark):
    assert len(lines(spark, {1: [A, (2.0, 2.0)], 2: [C, (0.0, 2.0)]}, {1: [1], 2: [2]})) == 2


def test_touching_street_splits(spark):
    got = lines(spark, {1: [A, C], 2: [B, D]}, {1: [1, 2]})
    assert got == sorted([(1, [A, B]), (1, [B, C]), (1, [B, D])])


def test_overlapping_streets_are_one(spark):
    # 0-2 and 1-3 on one straight line, and a part of the first drawn once more
    got = lines(spark, {1: [A, C], 2: [(3.0, 0.0), B], 3: [(0.5, 0.0), B]}, {1: [1, 2, 3]})
    assert got == [(1, [A, (0.5, 0.0), B, C, (3.0, 0.0)])]


def test_loop_at_a_junction_begins_there(spark):
    north, east = (1.0, 1.0), (2.0, 0.5)
    got = lines(spark, {1: [B, north, (0.0, 1.0), A, B], 2: [B, C], 3: [B, east]}, {1: [1, 2, 3]})
    assert got == sorted([(1, [B, A, (0.0, 1.0), north, B]), (1, [B, C]), (1, [B, east])])


def plain_split(edges):
    """Brute force: parts between all points in which an edge meets another."""
    from fractions import Fraction as Q

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    out = set()
    for a, b in edges:
        cuts = {a, b}
        for c, d in edges:
            if (a, b) == (c, d):
                continue
            s, t, u, v = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
            for p, z in ((c, s), (d, t)):
                if z == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
                    cuts.add(p)
            if s * t < 0 and u * v < 0:
                f = Q(s) / Q(s - t)
                cuts.add((c[0] + (d[0] - c[0]) * f, c[1] + (d[1] - c[1]) * f))
        spots = sorted(cuts, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        spots = [(round(float(x) / 1e7, 9), round(float(y) / 1e7, 9)) for x, y in spots]
        out |= {tuple(sorted(pair)) for pair in zip(spots, spots[1:])}
    return out


def test_noding_equals_brute_force(spark):
    """Random edges of two groups: a crowded corner, long ones across it, and many on a coarse grid."""
    from busnet.operators.noding import noded

    rng = np.random.default_rng(11)
    edges = {"x": set(), "y": set()}
    for group in edges:
        # on lattices, so that many touch and overlap; their step keeps crossings off the middle between two spots
        for span, count, step in ((40, 120, 64_000), (9, 60, 64_000), (4_000_000, 15, 1)):
            for p in (step * rng.integers(0, span, size=(count, 4))).tolist():
                a, b = sorted([(p[0], p[1]), (p[2], p[3])])
                if a != b:
                    edges[group].add((a, b))
    rows = [(g, *[(x / 1e7, y / 1e7) for x, y in e]) for g, es in edges.items() for e in es]
    df = spark.createDataFrame(rows, "g string, a struct<lon: double, lat: double>, b struct<lon: double, lat: double>")
    got = {}
    for r in noded(df, ["g"]).collect():
        got.setdefault(r.g, []).append((tuple(round(v, 9) for v in r.a), tuple(round(v, 9) for v in r.b)))
    for g, es in edges.items():
        # a crossing half-way between two spots of 1e-9 degrees may go to either
        nano = lambda e: tuple(round(v * 1e9) for p in e for v in p)
        wanted = {nano(e) for e in plain_split(es) if e[0] != e[1]}
        found = {nano(e) for e in got[g]}
        assert len(got[g]) == len(found) == len(wanted)
        for e in found - wanted:
            assert any(tuple(v + s for v, s in zip(e, step)) in wanted for step in product((-1, 0, 1), repeat=4))


def test_long_lines_and_rings_are_ranked(spark):
    """A line of 3,000 edges, a ring of 1,000, a lasso and single edges, against a walk."""
    from busnet.operators import ranking

    rng = np.random.default_rng(3)
    edges = [((i, 0), (i + 1, 0)) for i in range(3000)]
    names = rng.permutation(1000).tolist()
    edges += [((names[i], 5), (names[(i + 1) % 1000], 5)) for i in range(1000)]
    edges += [((0, 9), (1, 9)), ((1, 9), (2, 9)), ((2, 9), (3, 9)), ((3, 9), (1, 9)), ((7, 9), (8, 9))]
    edges = [tuple(sorted(e)) for e in edges]
    spot = "struct<lon: double, lat: double>"
    df = spark.createDataFrame(
        [(1, tuple(map(float, a)), tuple(map(float, b))) for a, b in edges], f"g int, a {spot}, b {spot}"
    ).repartition(8)
    got = {}
    for r in ranking.vertices(ranking.ranked(df, ["g"]), ["g"]).collect():
        got.setdefault(r.line, {})[r.pos] = (int(r.lon), int(r.lat))
    paths = sorted([p[i] for i in range(len(p))] for p in got.values())
    at = names.index(0)
    ring = [(names[(at + i) % 1000], 5) for i in range(1001)]
    if ring[1] > ring[-2]:
        ring.reverse()
    assert paths == sorted([
        [(i, 0) for i in range(3001)], ring, [(0, 9), (1, 9)], [(1, 9), (2, 9), (3, 9), (1, 9)], [(7, 9), (8, 9)],
    ])


def test_ids_are_gapless_and_repeatable(spark):
    from busnet.operators.ids import numbered

    df = spark.range(5000).selectExpr("id * 7919 % 5003 AS k", "id AS v").repartition(13)
    got = numbered(df, ["k"], "no").orderBy("k").collect()
    assert [r.no for r in got] == list(range(1, 5001)) and [r.k for r in got] == sorted(r.k for r in got)
    assert numbered(df.limit(0), ["k"], "no").count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(50)]
    star = [(100, i) for i in range(101, 400)]
    edges = spark.createDataFrame(path + star, "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 400)}}


# --- projection -----------------------------------------------------------------

def projection_net(spark, nodes, streets):
    f = SmallFeatures(spark, nodes=nodes, streets=streets, routes=[(1, "1", "")])
    f.members = [(1, i, "", 1, s) for i, s in enumerate(streets)]
    f.members += [(1, 10_000 + i, "stop", 0, n) for i, n in enumerate(nodes)]
    return Network(f)


def test_foot_beside_and_beyond(spark):
    net = projection_net(spark, {1: ("x", (0.5, 0.1)), 2: ("y", (1.5, 0.1))}, {9: [A, B]})
    got = {r["stop_key"]: (r["x"], r["y"]) for r in net.best_projection.collect()}
    metre = 6378137 * np.pi / 180
    assert got["x"] == (pytest.approx(0.5 * metre, abs=0.01), 0)
    assert got["y"] == (pytest.approx(metre, abs=0.01), 0)


def test_stops_without_name_share_a_point_but_null_does_not(spark):
    net = projection_net(
        spark, {1: ("", (0.2, 0.0)), 2: ("", (0.6, 0.0)), 3: (None, (0.8, 0.0)), 4: (None, (0.9, 0.0))}, {9: [A, B]}
    )
    assert sorted(r["stop_key"] for r in net.best_projection.collect()) == ["", "0_3", "0_4"]


@pytest.mark.parametrize("unit", ["degree", "metre"])
def test_busy_routes_give_the_same_points(spark, unit):
    rng = np.random.default_rng(3)
    spots = rng.uniform(0, 3000, size=(60, 2))
    nodes = {i + 1: (f"s{i}", at(*map(float, p))) for i, p in enumerate(spots)}
    streets = {}
    for i in range(80):
        p = spots[i % 60] + rng.normal(size=2) * 30
        q = p + rng.normal(size=2) * 200
        streets[1000 + i] = [at(*map(float, p)), at(*map(float, q))]
    net = projection_net(spark, nodes, streets)
    rows = lambda feet: sorted(map(tuple, feet.collect()))
    plain = rows(positions.projected_feet(net.i_positions, net.i_ways, unit))
    assert plain and rows(positions.projected_feet(net.i_positions, net.i_ways, unit, leaf=50)) == plain
    # against every pair: the nearest way in degrees, ties to the smaller index
    if unit == "degree":
        for row in plain[:20]:
            x, y = row[4], row[5]
            found = []
            for i, street in enumerate(streets.values()):
                (ax, ay), (bx, by) = [(lon * np.pi / 180 * 6378137, np.log(np.tan(np.pi / 4 + lat * np.pi / 360)) * 6378137) for lon, lat in street]
                t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                fx, fy = ax + (bx - ax) * t, ay + (by - ay) * t
                lon, lat = np.degrees(fx / 6378137), np.degrees(2 * np.arctan(np.exp(fy / 6378137)) - np.pi / 2)
                found.append((round(float(np.hypot(lon - row[6], lat - row[7])), 9), i))
            assert (row[9], row[8]) == min(found)


# --- connections and documents ----------------------------------------------------

@pytest.fixture(scope="module")
def hub(spark):
    f = SmallFeatures(
        spark,
        nodes={5: ("node five", at(0, 0)), 6: ("lonely", at(0, 900))},
        stop_ways={5: ("way five", [at(0, 0), at(10, 0)])},
        routes=[(1, "1", "red"), (2, None, ""), (3, "", None), (4, "4", None)],
        members=[(1, 0, "stop", 0, 5), (1, 1, "platform", 0, 5), (1, 2, "stop", 0, 6), (2, 0, "stop", 0, 5),
                 (3, 0, "stop", 0, 5), (4, 0, "stop", 0, 5)],
    )
    return Network(f)


def test_stops_match_on_the_id_alone(hub):
    names = {r["stop_name"] for r in hub.d_route_stops_with_connections.filter("stop_osm_id = 5").collect()}
    assert names == {"node five", "way five"}


def test_no_connection_is_one_empty_entry(hub):
    row = hub.d_route_stops_with_connections.filter("stop_osm_id = 6").first()
    assert [tuple(r) for r in row["other_routes_at_stop"]] == [(None, None, None)]
    listed = documents.stop_list(hub.d_route_stops_with_connections).filter("route_osm_id = 1").first()
    assert listed["stops"][-1]["shields"] == []
    assert [s["ref"] for s in listed["stops"][0]["shields"]] == ["4"]


def test_visits_are_counted_not_routes(hub):
    row = hub.d_stops.filter("osm_type = 0 AND osm_id = 5").first()
    assert row["number_of_routes"] == 5
    way = hub.d_stops.filter("osm_type = 1").first()
    assert way["number_of_routes"] is None


def test_shield_colours_and_numbers(hub):
    rows = hub.d_stops_shield.filter("osm_type = 0 AND osm_id = 5").orderBy("i").collect()
    assert [(r["i"], r["ref"], r["colour"]) for r in rows] == [
        (1, "", "gray"), (2, "1", "red"), (3, "4", "gray"), (4, None, "gray"),
    ]


def test_connections_equal_the_self_join(hub):
    p, r = hub.position_refs, hub.relations
    direct = (
        p.alias("p").join(p.alias("q"), (F.col("p.member_osm_id") == F.col("q.member_osm_id"))
                          & (F.col("p.member_type") == F.col("q.member_type"))
                          & (F.col("p.rel_osm_id") != F.col("q.rel_osm_id")))
        .select("p.rel_osm_id", "p.member_osm_id", F.col("q.rel_osm_id").alias("other")).distinct().count()
    )
    rows = hub.d_route_stops_with_connections.select(
        "route_osm_id", "stop_osm_id", F.explode("other_routes_at_stop.id").alias("other")
    ).filter("other IS NOT NULL").distinct().count()
    assert rows == direct


def test_documents(hub):
    docs = {r["osm_id"]: r for r in hub.route_documents.collect()}
    assert set(docs) == {1, 2, 3, 4}
    assert docs[1]["geometry"] is None
    assert docs[1]["stop_list"][0]["osm_id"] == "node/5"
    feature = hub.stop_documents.filter("osm_type = 1").first()
    assert feature["properties"]["osm_type"] == "way" and feature["properties"]["routes_at_stop"] == []
    one = documents.stop_attributes(hub.i_stops, 5, "way").collect()
    assert len(one) == 1 and one[0]["name"] == "way five"


def test_unknown_element_word():
    assert element_code(None) == 0 and element_code("relation") == 2
    with pytest.raises(ValueError):
        element_code("foo")


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([([(None, "b"), ("a", None), ("a", "z")],)], "v array<struct<x:string,y:string>>")
    got = df.select(sort_nulls_last(F.col("v"), "x", "y").alias("v")).first()["v"]
    assert [tuple(e) for e in got] == [("a", "z"), ("a", None), (None, "b")]


# --- tiles ------------------------------------------------------------------------

def tile_rows(spark, points, z, buffer=0, extent=tiles.WORLD):
    df = spark.createDataFrame(points, "x double, y double")
    got = tiles.assign_tiles(df, ["x", "y", "x", "y"], [z], buffer, extent).collect()
    return sorted((r["x_tile"], r["y_tile"]) for r in got)


def test_border_point_belongs_to_one_tile(spark):
    assert tile_rows(spark, [(0.0, 0.0)], 1) == [(1, 1)]


def test_buffer_reaches_neighbours(spark):
    assert tile_rows(spark, [(0.0, 0.0)], 1, buffer=2) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_extent_limits_tiles(spark):
    assert tile_rows(spark, [(1e6, 1e6), (-1e6, 1e6)], 2, extent=(1.0, 1.0, 20.0, 20.0)) == [(2, 1)]


def test_three_valued_street_filter(spark):
    rows = [(None, 1), (None, 2), (7000, 1), (100, 1)]
    df = spark.createDataFrame(
        [(i, d, n, 1.0, [A, B]) for i, (d, n) in enumerate(rows)],
        "id long, max_diameter int, number_of_routes int, length double, geom array<struct<lon:double,lat:double>>",
    )
    low = tiles.layer_rows(df, tiles.WAYS, tiles.WAYS.queries[0])
    assert {r["id"] for r in low.collect()} == {1, 2}
    high = tiles.layer_rows(df, tiles.WAYS, tiles.WAYS.queries[1], zooms=[12])
    assert {r["id"] for r in high.collect()} == {0, 1, 2, 3}


def test_limit_per_tile(spark):
    df = spark.range(1500).selectExpr("0 AS osm_type", "id AS osm_id", "'n' AS name", "false AS has_polygon",
                                      "id * 1e-3D AS x", "1.0D AS y")
    rows = tiles.layer_rows(df, tiles.STATIONS, tiles.STATIONS.queries[0], zooms=[6])
    assert rows.count() == 1000 and rows.agg(F.max("osm_id")).first()[0] == 999


def test_snap_drops_repeats(spark):
    half = geo.HALF_WORLD
    df = spark.createDataFrame(
        [(0, 0, 0, [(-half, half), (-half + 1, half), (0.0, 0.0)])],
        "z int, x_tile int, y_tile int, pts array<struct<x:double,y:double>>",
    )
    assert [tuple(p) for p in df.select(tiles.snap(F.col("pts")).alias("p")).first()["p"]] == [(0, 0), (128, 128)]


def test_circles_of_few_points_are_those_of_one_by_one():
    """One point, two, two alike, and more, as the smallest circle of each alone."""
    from busnet.functions.hull import enclosing_circle, enclosing_circles

    rng = np.random.default_rng(5)
    flat = [rng.uniform(-90, 90, 2 * n) for n in (1, 2, 3, 1, 5, 2, 20, 2)] + [np.array([1.0, 2.0, 1.0, 2.0]), np.array([3.0, 4.0])]
    alone = np.array([enclosing_circle(a.reshape(-1, 2)) for a in flat])
    assert np.allclose(enclosing_circles(flat), alone, rtol=1e-14, atol=1e-14)
    assert enclosing_circles([]).shape == (0, 3)
