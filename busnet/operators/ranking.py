"""Lines of edges put in order by pointer jumping (list ranking).

Every edge is two half-edges.  At a vertex of exactly two edges a half-edge has a successor; at any other it ends.
In each round every half-edge that has not reached an end takes over the pointer of the one it points to, so a
line of n edges is ranked in log2(n) rounds of one equi-join, and no line is gathered.  A ring has no end: when a
round brings no half-edge to an end and the least vertex seen by those left does not change any more, each of them
knows the least vertex of its ring, the ring is opened there and ranked like a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from busnet.session import cut_lineage


def _key(group: list[str], *ends: str) -> Column:
    """128-bit identity of a half-edge."""
    parts = [F.col(c) for c in (*group, *ends)]
    return F.struct(F.xxhash64(F.lit(0), *parts).alias("p"), F.xxhash64(F.lit(1), *parts).alias("q"))


def _half_edges(edges: DataFrame, group: list[str]) -> DataFrame:
    """(h, u, v, next): half-edges u-v of each group and the one that follows at v, null at an end."""
    both = edges.select(
        *group, F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    ).select(*group, "e.*")
    # the other ends of the two edges at a vertex
    passed = both.groupBy(*group, F.col("u").alias("v")).agg(
        F.count("*").alias("n"), F.min("v").alias("one"), F.max("v").alias("two")
    ).filter("n = 2").drop("n")
    follows = both.join(passed, [*group, "v"], "left").withColumn(
        "w", F.when(F.col("u") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    )
    return follows.select(
        *group, "u", "v", _key(group, "u", "v").alias("h"), F.when(F.col("w").isNotNull(), _key(group, "v", "w")).alias("next")
    )


def _jump(half: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(h, end, d): the last half-edge of each and how many follow; and (h, low) of those in rings, if any."""
    state = half.select(
        "h", F.coalesce("next", "h").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("d"),
        F.col("next").isNull().alias("done"), F.least("u", "v").alias("low"),
    )
    state = cut_lineage(state)
    finished, active = [state.filter("done")], state.filter("NOT done")
    left, lows = active.count(), None
    while left:
        known = reduce(DataFrame.unionByName, finished).unionByName(active).select(
            F.col("h").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("done").alias("done2"), F.col("low").alias("low2")
        )
        moved = cut_lineage(
            active.join(known, "to").select(
                "h", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"),
                F.least("low", "low2").alias("low"),
            )
        )
        finished.append(moved.filter("done"))
        active = moved.filter("NOT done")
        now = active.agg(F.count("*"), F.expr("bit_xor(xxhash64(h, low))"), F.expr("bit_xor(xxhash64(low, h, 1))")).first()
        if now[0] == left and now[1:] == lows:
            break
        left, lows = now[0], now[1:]
    ranked = reduce(DataFrame.unionByName, finished).select("h", F.col("to").alias("end"), "d")
    return ranked, active.select("h", "low") if left else None


def ranked(edges: DataFrame, group: list[str]) -> DataFrame:
    """Distinct edges (group, a, b) -> (group, line, u, v, d): each edge in the direction of its line.

    `line` identifies the line, d counts the edges after it.  A line begins at its smaller end; one that returns
    to the vertex it began at, or a ring, which begins at its least vertex, goes to the smaller neighbour first.
    """
    half = cut_lineage(_half_edges(edges, group))
    lines, rings = _jump(half)
    if rings is not None:
        opened = half.join(rings, "h").withColumn("next", F.when(F.col("v") != F.col("low"), F.col("next"))).drop("low")
        more, _ = _jump(opened)
        lines = lines.unionByName(more)
    ends = half.select(F.col("h").alias("end"), F.col("u").alias("end_u"), F.col("v").alias("end_v"))
    placed = half.drop("next").join(lines, "h").join(ends, "end")
    # of the two directions of an edge the one with the greater last vertex, then the greater one before it
    by_edge = placed.select(
        *group, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"),
        F.struct("end_v", "end_u", "end", "u", "v", "d").alias("way"),
    ).groupBy(*group, "a", "b").agg(F.max("way").alias("way"))
    return by_edge.select(*group, F.col("way.end").alias("line"), "way.u", "way.v", "way.d")


def vertices(lines: DataFrame, group: list[str]) -> DataFrame:
    """`ranked` edges -> (group, line, pos, lon, lat): the vertices of each line in row form, pos from 0."""
    size = lines.groupBy("line").agg((F.max("d") + 1).alias("n"))
    spots = F.when(
        F.col("d") == 0, F.array(F.struct(F.col("d").alias("d"), F.col("u").alias("p")), F.struct(F.lit(-1).cast("long").alias("d"), F.col("v").alias("p")))
    ).otherwise(F.array(F.struct(F.col("d").alias("d"), F.col("u").alias("p"))))
    rows = lines.select(*group, "line", F.explode(spots).alias("s"))
    return rows.join(size, "line").select(*group, "line", (F.col("n") - 1 - F.col("s.d")).alias("pos"), F.col("s.p.lon").alias("lon"), F.col("s.p.lat").alias("lat"))
