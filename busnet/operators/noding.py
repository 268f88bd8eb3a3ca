"""Noding: edges of one group are split where they cross, touch or overlap.

Decisions are exact: vertices are taken on the grid of 1e-7 degrees that map data are stored in, and the side of
a vertex is a difference of products of whole numbers.  A crossing point is rounded to 1e-9 degrees, so that three
edges through one spot share a vertex.  Lines are straight in longitude and latitude.

Edges meet in grid cells.  A cell that more than `_CROWD` edges of a group pass is quartered until it is not, or until it is
smaller than the grid of the vertices; so a crowded corner costs comparisons near it only, and no cell is paired whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from busnet.functions import geo
from busnet.session import cut_lineage

_UNIT = 1e7  # vertices per degree
_FIRST = 18  # the first cells are 2^18 units wide, some 3 km
_CROWD = 24
#: Edges that span more (units, some 200 degrees) have products beyond a long; they are not split.
_LONGEST = 2_000_000_000


def _cells(shift: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Cells (i, j) of width 2^shift, inside box (in cells), that the edge (ax, ay)-(bx, by) may pass."""
    width = F.pow(F.lit(2.0), shift)
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    slope = F.when(F.col("ax") != F.col("bx"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))

    def cell(v: Column) -> Column:
        return F.floor(v / width).cast("long")

    def rows(i: Column) -> Column:
        # the part of the edge in column i, one unit wider on all sides
        x0, x1 = F.greatest(left, i * width) - 1, F.least(right, (i + 1) * width) + 1
        y0, y1 = F.col("ay") + (x0 - F.col("ax")) * slope, F.col("ay") + (x1 - F.col("ax")) * slope
        bottom = F.greatest(F.coalesce(F.least(y0, y1) - 1, low), low)
        top = F.least(F.coalesce(F.greatest(y0, y1) + 1, high), high)
        a, b = F.greatest(cell(bottom), box[1]), F.least(cell(top), box[3])
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda j: F.struct(i.alias("i"), j.alias("j")))).otherwise(
            F.array().cast("array<struct<i:bigint,j:bigint>>")
        )

    first, last = F.greatest(cell(left), box[0]), F.least(cell(right), box[2])
    return F.when(first <= last, F.flatten(F.transform(F.sequence(first, last), rows)))


def _placed(edges: DataFrame, group: list[str]) -> DataFrame:
    """Each edge with the cells it passes, none of them crowded."""
    far = F.lit(2**40)
    now = edges.withColumn("shift", F.lit(_FIRST)).withColumn("c", F.explode(_cells(F.col("shift"), (-far, -far, far, far))))
    now = cut_lineage(now.select("*", "c.i", "c.j").drop("c"))
    here = [*group, "shift", "i", "j"]
    done = None
    for shift in range(_FIRST - 1, -2, -1):
        count = now.groupBy(*here).agg(F.count("*").alias("n")).filter(f"n > {_CROWD}").drop("n")
        crowded = cut_lineage(count)
        ready = shift < 0 or crowded.isEmpty()
        calm = now if ready else now.join(crowded, here, "left_anti")
        done = calm if done is None else done.unionByName(calm)
        if ready:
            return done
        quarters = (F.col("i") * 2, F.col("j") * 2, F.col("i") * 2 + 1, F.col("j") * 2 + 1)
        now = cut_lineage(
            now.join(crowded, here, "left_semi")
            .withColumn("c", F.explode(_cells(F.lit(shift), quarters)))
            .withColumn("shift", F.lit(shift)).withColumn("i", F.col("c.i")).withColumn("j", F.col("c.j")).drop("c")
        )
    return done


def _side(p: str, q: str, r: str) -> Column:
    """Twice the area of the triangle p, q, r; its sign says on which side of p-q r lies."""
    x, y = (lambda v: F.col(f"{v}x")), (lambda v: F.col(f"{v}y"))
    return (x(q) - x(p)) * (y(r) - y(p)) - (y(q) - y(p)) * (x(r) - x(p))


def _inside(side: Column, p: str, q: str, r: str) -> Column:
    """Whether r lies on the edge p-q but is no end of it."""
    x, y = (lambda v: F.col(f"{v}x")), (lambda v: F.col(f"{v}y"))
    between = (
        (x(r) >= F.least(x(p), x(q))) & (x(r) <= F.greatest(x(p), x(q))) & (y(r) >= F.least(y(p), y(q))) & (y(r) <= F.greatest(y(p), y(q)))
    )
    end = ((x(r) == x(p)) & (y(r) == y(p))) | ((x(r) == x(q)) & (y(r) == y(q)))
    return (side == 0) & between & ~end


def _cuts(placed: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b, cut): the points at which the edge a-b is to be split."""
    ends = ["a", "b", "ax", "ay", "bx", "by"]
    other = placed.select(
        *group, "shift", "i", "j", F.col("a").alias("c"), F.col("b").alias("d"),
        *[F.col(o).alias(n) for o, n in (("ax", "cx"), ("ay", "cy"), ("bx", "dx"), ("by", "dy"))],
    )
    meets = (
        (F.struct("a", "b") < F.struct("c", "d"))
        & (F.least("ax", "bx") <= F.greatest("cx", "dx")) & (F.least("cx", "dx") <= F.greatest("ax", "bx"))
        & (F.least("ay", "by") <= F.greatest("cy", "dy")) & (F.least("cy", "dy") <= F.greatest("ay", "by"))
    )
    pairs = placed.select(*group, "shift", "i", "j", *ends).join(other, [*group, "shift", "i", "j"]).filter(meets).select(
        *group, *ends, "c", "d", "cx", "cy", "dx", "dy",
        _side("a", "b", "c").alias("s_c"), _side("a", "b", "d").alias("s_d"), _side("c", "d", "a").alias("s_a"), _side("c", "d", "b").alias("s_b"),
    )
    crossing = (F.signum("s_c") * F.signum("s_d") < 0) & (F.signum("s_a") * F.signum("s_b") < 0)
    # how far along c-d the crossing is
    t = F.col("s_c").cast("double") / (F.col("s_c").cast("double") - F.col("s_d"))
    spot = geo.point(
        F.round(F.col("c.lon") + (F.col("d.lon") - F.col("c.lon")) * t, 9), F.round(F.col("c.lat") + (F.col("d.lat") - F.col("c.lat")) * t, 9)
    )
    touches = [
        ("a", "b", "c", "s_c"), ("a", "b", "d", "s_d"), ("c", "d", "a", "s_a"), ("c", "d", "b", "s_b"),
    ]
    found = F.array(
        *[F.when(_inside(F.col(s), p, q, r), F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("cut"))) for p, q, r, s in touches],
        *[F.when(crossing, F.struct(F.col(p).alias("a"), F.col(q).alias("b"), spot.alias("cut"))) for p, q in (("a", "b"), ("c", "d"))],
    )
    return pairs.select(*group, F.explode(F.array_compact(found)).alias("f")).select(*group, "f.*").distinct()


def noded(edges: DataFrame, group: list[str]) -> DataFrame:
    """Distinct edges (group, a, b; a < b) -> distinct edges that meet at their ends only."""
    def on_grid(end: str, of: str) -> Column:
        return F.round(F.col(f"{end}.{of}") * F.lit(_UNIT)).cast("long")

    whole = edges.select(
        *group, "a", "b", *[on_grid(end, of).alias(end + axis) for end in "ab" for axis, of in (("x", "lon"), ("y", "lat"))]
    )
    short = (F.abs(F.col("ax") - F.col("bx")) < _LONGEST) & (F.abs(F.col("ay") - F.col("by")) < _LONGEST)
    cuts = cut_lineage(_cuts(_placed(whole.filter(short), group), group))
    if cuts.isEmpty():
        return edges
    edge = [*group, "a", "b"]
    dx, dy = (lambda p: p["lon"] - F.col("a.lon")), (lambda p: p["lat"] - F.col("a.lat"))
    along = dx(F.col("p")) * dx(F.col("b")) + dy(F.col("p")) * dy(F.col("b"))
    split = cuts.select(*edge).distinct()
    points = cuts.select(*edge, F.col("cut").alias("p")).unionByName(
        split.select(*edge, F.explode(F.array("a", "b")).alias("p"))
    ).withColumn("t", along)
    in_order = Window.partitionBy(*edge).orderBy("t", "p")
    parts = (
        points.withColumn("next", F.lead("p").over(in_order)).filter(F.col("next").isNotNull() & (F.col("p") != F.col("next")))
        .select(*group, F.least("p", "next").alias("a"), F.greatest("p", "next").alias("b"))
    )
    return edges.join(split, edge, "left_anti").unionByName(parts).distinct()
