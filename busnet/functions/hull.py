"""Convex hull and smallest enclosing circle of point arrays, as Arrow-batched UDFs.

Points travel as one flat array [x0, y0, x1, y1, ...].
"""

from __future__ import annotations

import math
import random
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from busnet.functions.geo import A, E2, ECC

CIRCLE_SEGMENTS = 192

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SMALL = 16


def hull_points(xy: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull of an (n, 2) array (monotone chain)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[tuple[float, float]] = []
        for px, py in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0:
                    break
                out.pop()
            out.append((px, py))
        return out[:-1]

    ordered = pts.tolist()
    return np.array(chain(ordered) + chain(reversed(ordered)))


def _through_two(a, b):
    cx, cy = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    return cx, cy, max(math.hypot(a[0] - cx, a[1] - cy), math.hypot(b[0] - cx, b[1] - cy))


def _through_three(a, b, c):
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    if d == 0:  # collinear: the two ends decide
        return max((_through_two(p, q) for p, q in ((a, b), (a, c), (b, c))), key=lambda s: s[2])
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return a[0] + ux, a[1] + uy, math.hypot(ux, uy)


def _outside(p, circle):
    return math.hypot(p[0] - circle[0], p[1] - circle[1]) > circle[2] * (1 + 1e-12) + 1e-15


def enclosing_circle(xy: np.ndarray) -> tuple[float, float, float]:
    """(cx, cy, r) of the smallest circle around an (n, 2) array, n >= 1; expected linear time."""
    pts = (hull_points(xy) if len(xy) > _SMALL else xy).tolist()
    if len(pts) > 3:
        random.Random(len(pts)).shuffle(pts)
    circle = (pts[0][0], pts[0][1], 0.0)
    for i, p in enumerate(pts):
        if not _outside(p, circle):
            continue
        circle = (p[0], p[1], 0.0)
        for j, q in enumerate(pts[:i]):
            if not _outside(q, circle):
                continue
            circle = _through_two(p, q)
            for r in pts[:j]:
                if _outside(r, circle):
                    circle = _through_three(p, q, r)
    return circle


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hull_udf(flat: pd.Series) -> pd.Series:
    def one(a):
        if a is None or len(a) <= 2 * _SMALL:
            return a
        return hull_points(np.asarray(a).reshape(-1, 2)).ravel()

    return flat.map(one)


def _authalic_q(lat: np.ndarray) -> np.ndarray:
    s = np.sin(np.radians(lat))
    es = ECC * s
    return (1 - E2) * (s / (1 - es * es) + np.log((1 + es) / (1 - es)) / (2 * ECC))


def circle_area(cx: np.ndarray, cy: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Square metres on the spheroid inside circles drawn in degree space (as 192-gons)."""
    angle = np.arange(CIRCLE_SEGMENTS + 1) * (2 * math.pi / CIRCLE_SEGMENTS)
    lon = cx[:, None] + r[:, None] * np.cos(angle)
    q = _authalic_q(cy[:, None] + r[:, None] * np.sin(angle))
    strips = np.radians(np.diff(lon, axis=1)) * (q[:, 1:] + q[:, :-1])
    return np.abs(strips.sum(axis=1)) * (A * A / 4)


def enclosing_circles(flat: list) -> np.ndarray:
    """`enclosing_circle` of each flat point array: (n, 3).  Arrays of one point or two are done together."""
    found = np.zeros((len(flat), 3))
    sizes = np.fromiter((len(a) for a in flat), np.int64, len(flat))
    one, two = np.flatnonzero(sizes == 2), np.flatnonzero(sizes == 4)
    if len(one):
        found[one, :2] = np.array([flat[i] for i in one], np.float64)
    if len(two):
        p = np.array([flat[i] for i in two], np.float64)
        middle = (p[:, :2] + p[:, 2:]) / 2
        radius = np.maximum(np.hypot(*(p[:, :2] - middle).T), np.hypot(*(p[:, 2:] - middle).T))
        apart = (np.hypot(*(p[:, 2:] - p[:, :2]).T) > 1e-15)[:, None]
        found[two] = np.where(apart, np.column_stack([middle, radius]), np.column_stack([p[:, :2], np.zeros(len(p))]))
    for i in np.flatnonzero((sizes != 2) & (sizes != 4)):
        found[i] = enclosing_circle(np.asarray(flat[i], np.float64).reshape(-1, 2))
    return found


@F.pandas_udf(T.DoubleType())
def circle_diameter_udf(flat: pd.Series) -> pd.Series:
    """Metres across a disc as large as the smallest circle around the points."""
    found = enclosing_circles(flat.tolist())
    area = np.zeros(len(found))
    # a circle of one spot has no area
    drawn = np.flatnonzero(found[:, 2] != 0)
    if len(drawn):
        area[drawn] = circle_area(*found[drawn].T)
    return pd.Series(2 * np.sqrt(area / math.pi))


# keeps the optimizer from folding a call into the aggregation that follows it
hull_udf = hull_udf.asNondeterministic()
circle_diameter_udf = circle_diameter_udf.asNondeterministic()
