"""Centroid clustering against the same rounds in Python's whole numbers, and its bounds against distances."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from busnet.llm import centroids

SMALL = centroids.Settings(clusters=4, rounds=5, width=6, pivots=4)


def plain(rows, settings):
    """[(vec_id, cluster, distance)] and the centroids."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == settings.width and all(a is not None and math.isfinite(a) for a in x):
            kept.append((i, [math.floor(settings.scale * a) for a in x]))
    digest = lambda i: hashlib.sha256(f"{settings.seed}{'' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<f8").tobytes()))[: settings.clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, m), c) for c, m in enumerate(means))
    for _ in range(settings.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [[sum(col) // len(groups[c]) for col in zip(*groups[c])] if c in groups else m for c, m in enumerate(means)]
    return [(i, nearest(v)[1], min(nearest(v)[0], 2**63 - 1)) for i, v in kept], means


def check(spark, rows, settings=SMALL, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    df = df.withColumn("cluster", F.lit("x")).withColumn("start", F.lit(1)).withColumn("v", F.lit(2))
    members, found, counts = centroids.cluster(df, settings)
    wanted, means = plain(rows, settings)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, members.collect()), key=key) == sorted(wanted, key=key)
    assert found == means
    return members, found, counts


def test_clusters(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i, [a + rng.gauss(0, 0.05) for a in rng.choice(centres)]) for i in range(800)]
    members, found, counts = check(spark, rows)
    assert counts["of"] == 800 * 4 * 5 and counts["measured"] < 0.7 * counts["of"]
    table = centroids.with_inertia(members, found).collect()
    assert len(table) == 800 and {r.inertia for r in table} == {sum(r.distance for r in table)}
    for r in table:
        assert r.cluster_inertia == sum(s.distance for s in table if s.cluster == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, found[r.cluster])).encode()).hexdigest()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [0.5, -0.25, 0.0, 1.0, -1.0, 0.125]
    rows = [
        (1, one), (1, one), (2, one), (3, [-a for a in one]), (4, None), (5, []), (6, one[:5]), (7, one + [1.0]), (8, [nan] + one[1:]),
        (9, [inf] + one[1:]), (10, [None] + one[1:]), (None, [0.0] * 6), (12, [-0.0001] * 6), (13, [0.3] * 6), (14, [-0.3] * 6),
    ]
    check(spark, rows)
    # one vector three times, so three centroids start alike and two stay empty
    check(spark, [(1, one)] * 9 + [(2, [0.0] * 6)])
    check(spark, [(3, one)])
    # numbers that no 64-bit sum holds
    check(spark, rows + [(20, [1e30, -1e30, 1e25, 3.0, 0.0, 1.0]), (21, [1e30, 1e30, 0.0, 0.0, 0.0, 0.0]), (22, [3e9] * 6)])
    check(spark, [(i, [1e300 * (1 + i), 0.0, 0.0, 0.0, 0.0, float(i)]) for i in range(6)])
    for none in ([], [(1, None), (2, [1.0])]):
        members, found, _ = check(spark, none)
        assert centroids.with_inertia(members, found).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for _ in range(30):
        x = np.floor(rng.normal(0, 300, (200, 8)))
        x[50:60] = x[:10]
        pivots = centroids.choose_pivots(x[:40], 6)
        middle = x[rng.integers(0, 200, 5)]
        low = centroids.lower_bounds(centroids.distances(x, pivots), centroids.distances(middle, pivots), pivots)
        true = np.sqrt(((x[:, None] - middle[None]) ** 2).sum(2))
        assert (low <= true).all() and low.max() > 0


def test_measured_of_production_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    members, found, counts = centroids.cluster(df)
    wanted, means = plain([(r.vec_id, r.embedding) for r in df.collect()], centroids.Settings())
    assert sorted(map(tuple, members.collect())) == sorted(wanted) and found == means
