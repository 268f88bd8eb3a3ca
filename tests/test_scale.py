"""Steps that must not be repeated or carry more than they need, with the results they must keep."""

import pytest
from pyspark.sql import functions as F

from busnet.operators import connections, documents, positions
from busnet.plans import oracles, queries
from busnet.plans.network import Network
from tests.small import SmallFeatures, at

SF = "/root/testdata/sf0.001"


def net(spark, routes=(1, 2)):
    return Network(SmallFeatures(
        spark, nodes={5: ("A", at(0, 0)), 6: ("B", at(300, 10))},
        streets={100: [at(-50, 20), at(50, 20)], 101: [at(250, 40), at(350, 40), at(400, 40)], 102: [at(-50, 20), at(50, 20)]},
        routes=[(i, "a", "red") for i in routes],
        members=[(r, 10 * k, role, kind, o) for r in routes for k, (role, kind, o) in enumerate(
            [("stop", 0, 5), ("", 1, 101), ("", 1, 100), ("stop", 0, 6), ("", 1, 102)])],
    ))


def test_every_way_of_a_route_is_measured(spark):
    """stop_projection holds each position on each way, not on the nearest alone."""
    n = net(spark)
    found = sorted((r.rel_osm_id, r.member_osm_id, r.way_index) for r in queries._REGISTRY["stop_projection"](n).collect())
    assert found == [(r, s, w) for r in (1, 2) for s in (5, 6) for w in (10, 20, 40)]
    assert "QUALIFY" not in oracles._SELECTS["stop_projection"]


@pytest.mark.parametrize("leaf", [1, 4, 4096])
def test_hot_routes_are_measured_alike(spark, leaf):
    n = net(spark)
    again = n.i_positions.unionByName(n.i_positions.filter("member_osm_id = 5"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    near = rows(positions.projected_feet(again, n.i_ways, leaf=leaf))
    assert [(r[0], r[2], r[8]) for r in near] == [(r, s, w) for r in (1, 2) for s, w in ((5, 20), (5, 20), (6, 10))]
    assert rows(positions.nearest_ways(again, n.i_ways, leaf=leaf)) == rows(positions.nearest_ways(n.i_positions, n.i_ways))


@pytest.mark.parametrize("name", ["positions_by_route", "route_stop_positions", "route_position_list", "segments_by_route"])
def test_shared_tables_are_worked_out_once(spark, name):
    """What two steps read is stored: the plan that is left reads no members any more."""
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "lineitem.parquet" not in plan


def test_shields_travel_as_text(spark):
    odd = [("1~/;", "~0"), ("1~/;", None), ("1~/;", ""), ("a", "re;d"), ("a", "re;d"), ("b/", None), (None, "x"), ("", "y")]
    df = spark.createDataFrame([([(i, *p) for i, p in enumerate(odd)],), ([],)], "found array<struct<id: long, ref: string, colour: string>>")
    got = df.select(connections.shields_of_text(connections.shield_text(F.col("found"))).alias("s")).collect()
    assert [tuple(map(tuple, r.s)) for r in got] == [tuple(p for p in odd if p[0]), ()]


def test_shields_of_a_stop_leave_out_the_own_route_only(spark):
    """Routes of one ref and colour, routes given twice, alike or not, and one without a ref."""
    lines = [(1, "a", "red"), (2, "a", "red"), (2, "a", "red"), (3, "a", None), (3, "a~", None), (4, None, "red")]
    f = SmallFeatures(spark, nodes={5: ("A", at(0, 0))}, routes=lines, members=[(r, 1, "stop", 0, 5) for r in (1, 2, 3, 4)])
    n = Network(f)
    assert "shields" not in n.d_route_stops_with_connections.columns

    def listed(rows):
        return sorted((r.route_osm_id, [[tuple(h) for h in s.shields] for s in r.stops]) for r in documents.stop_list(rows).collect())

    # as made of the published list
    assert listed(n.stop_connections) == listed(n.d_route_stops_with_connections)
    assert dict(listed(n.stop_connections))[1] == [[("a", "red"), ("a", "red"), ("a", None), ("a~", None)]]


def test_clusters_settle_way_stops_before_they_join(spark):
    """Whether a way stop lies in its own surroundings is worked out once, not for every line of the extract."""
    n = queries.network(spark, SF)
    assert "lineitem" not in (plan := n.cluster_members._jdf.queryExecution().toString()) and "supplier.parquet" not in plan


def test_windows_are_handed_on_in_parts(spark, monkeypatch):
    """Few windows and pairs at a time give the same matches."""
    from busnet.llm import decontam

    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"x{i} {words} y {words} z") for i in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(1, words), (2, words + " t")], "item_id long, text string")
    plain = sorted(map(tuple, decontam.matches(docs, items).collect()))
    source = open(decontam.__file__).read()
    assert "tolist(), by))" not in source
    monkeypatch.setattr(decontam, "_HELD", 10)
    monkeypatch.setattr(decontam, "_PAIRS", 1)
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == plain and len(plain) >= 12


def test_feet_are_found_inside_the_row(spark):
    """A position meets the ways of its route in one row: no pair is unfolded into rows that are sorted and spilled."""
    n = net(spark)
    for feet in (positions.projected_feet, positions.nearest_ways):
        plan = feet(n.i_positions, n.i_ways)._jdf.queryExecution().executedPlan().toString()
        assert "min(struct" not in plan and "explode(segments" not in plan


@pytest.mark.parametrize("unit", ["degree", "metre"])
@pytest.mark.parametrize("leaf", [1, 4096])
def test_lines_of_one_place_are_one_way(spark, unit, leaf):
    """Two lines with one member index, a line given twice and a single vertex: the nearest spot of the place counts."""
    from busnet.operators.routes import with_centroid

    lines = [(1, 10, [at(0, 30), at(50, 30)]), (1, 10, [at(0, 5), at(50, 5)]), (1, 20, [at(0, 8), at(50, 8)]), (1, 20, [at(0, 8), at(50, 8)]), (1, 30, [at(9, 9)])]
    ways = spark.createDataFrame(lines, "rel_osm_id long, index int, geom array<struct<lon: double, lat: double>>")
    stops = with_centroid(spark.createDataFrame([(1, 0, 5, 1, [at(10, 0)])], "rel_osm_id long, member_type int, member_osm_id long, member_index int, geom array<struct<lon: double, lat: double>>"))
    every = {r.way_index: r.dist for r in positions.nearest_ways(stops, ways, unit, leaf).collect()}
    assert sorted(every) == [10, 20, 30] and every[10] < every[20] < every[30]
    (best,) = positions.projected_feet(stops, ways, unit, leaf).collect()
    assert best.way_index == 10 and best.dist == every[10]


def test_blocks_of_short_routes_are_looked_up_once(spark):
    """The stop before a block is asked for on routes of several blocks only; they keep their distances."""
    from busnet.operators import routes

    n = net(spark)
    whole = sorted(map(tuple, routes.stop_spacing(n.members).collect()))
    assert sorted(map(tuple, routes.stop_spacing(n.members, 4).collect())) == whole and len(whole) == 4
    assert "LeftSemi" in routes.stop_spacing(n.members)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_dealt_by_route_once(spark):
    """Rows with the text of a stop go to their route as they are, not as lists begun before; a visit given twice counts once."""
    n = net(spark)
    plan = documents.stop_list(n.stop_connections)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(route_osm_id" not in plan
    rows = lambda df: sorted(map(str, documents.stop_list(df).collect()))
    twice = connections.route_stop_connections(n.i_positions.unionByName(n.i_positions), n.i_stops, n.relations, lists=False)
    assert rows(twice) == rows(n.stop_connections) == rows(n.d_route_stops_with_connections)


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a stored table was shuffled for is deleted when it is written, and the option is as before."""
    import time

    from busnet import session

    def held() -> set:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    before = held()
    kept = session.keep(spark.range(1000).repartition(4, "id"), "trial", release=True)
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and kept.count() == 1000
    assert spark.conf.get(session._RELEASE, None) is None


def test_documents_made_in_shares_are_those_made_at_once(spark):
    """Routes without stops, one given twice and one without an id are in one share each."""
    f = net(spark, (1, 2, 3, 3)).features
    f.members = [m for m in f.members if m[0] != 2]
    relations = f.relations_route.unionByName(f.relations_route.limit(1).selectExpr("CAST(NULL AS LONG) AS osm_id", *[f"`{c}`" for c in f.relations_route.columns[1:]]))
    made = []

    def documents_of(**how):
        n = Network(f, **how)
        n.relations = n.features.relations_route.unionByName(relations.filter("osm_id IS NULL")).selectExpr("abs(osm_id) AS osm_id", *[f"`{c}`" for c in relations.columns[1:]])
        return sorted(map(str, n.route_documents.collect()))

    whole = documents_of()
    keep = lambda name, df: made.append(name) or df
    assert documents_of(keep=keep, share=3) == whole and len(whole) == 4
    assert made.count("t_route_documents") == 3
