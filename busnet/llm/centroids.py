"""Centroid clustering with Ptolemaic pivots.

Vectors are turned into whole numbers once and written with their distances to a few pivots.  For fixed pairs
(p, s) of pivots Ptolemy's inequality gives d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s) for a vector
x and a centroid c, from cached distances alone.  In each round the centroid with the least bound is measured
exactly, every other one whose bound lies above that distance is ruled out, and the survivors are measured
exactly.  Bounds are rounded down by more than the error of their arithmetic, so a tie is never ruled out and the
result is that of comparing everything.

A round is one pass over the written vectors.  Tasks hand on sums in digits of 30 bits, which Spark adds up, so
means are exact for numbers of any size; the driver takes clusters x components sums a round, whatever the corpus.
Pivots come from a sample of fixed size, which affects only how much is ruled out.

Rows: vectors of another length, null ones and those with a null or non-finite component take no part, nor do
those that a double cannot hold after scaling.  Repeated rows are each a vector; equal vectors may start several
centroids, of which the first takes all ties.  A null vec_id is kept and hashes as an empty one.  With fewer vectors
than clusters there are fewer centroids.  Distances beyond a long are cut to the greatest long.  An empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from busnet.session import keep

_LONGEST = 2**63 - 1
_DIGIT = 30


def _plain(width: int) -> float:
    """Components below this have sums of squared differences below 2^52, which doubles hold exactly."""
    return 2.0 ** ((52 - max(width - 1, 1).bit_length()) // 2 - 1)


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    rounds: int = 10
    width: int = 64
    scale: float = 1024.0
    #: Put before vec_id to hash the vectors that centroids start at.
    seed: str = "3:"
    pivots: int = 8
    #: Vectors that pivots are drawn from.
    sample: int = 512


def quantised(vectors: DataFrame, settings: Settings) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, start, v): floor(scale * x) as little-endian doubles."""
    width, scale = settings.width, settings.scale
    start = F.sha2(F.concat(F.lit(settings.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, found = batch.column("embedding"), []
            fits = [i for i, x in enumerate(raw) if x.is_valid and len(x) == width]
            for i in fits:
                values = raw[i].values
                if values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    found.append((i, v.astype("<f8").tobytes()))
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rows), batch.column("start").take(rows), pa.array([v for _, v in found], pa.binary())],
                ["vec_id", "start", "v"],
            )

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", start.alias("start"), "embedding").mapInArrow(run, f"vec_id {id_type}, start string, v binary")


def matrix(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), width)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the vector farthest from those before it; no two are equal."""
    chosen = [sample[0]]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(sample[nearest.argmax()])
        nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def pairs_of(pivots: np.ndarray) -> list[tuple[int, int]]:
    """The fixed pairs: the first pivot with every other, and each with the next."""
    n = len(pivots)
    return sorted({(0, i) for i in range(1, n)} | {(i, i + 1) for i in range(1, n - 1)})


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in points], 1) if len(points) else np.zeros((len(x), 0))


def lower_bounds(far: np.ndarray, centroid_far: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows x centroids: bounds of the distance, rounded down by more than the error of the arithmetic."""
    low = np.zeros((len(far), len(centroid_far)))
    for p, s in pairs_of(pivots):
        apart = np.sqrt(((pivots[p] - pivots[s]) ** 2).sum())
        a, b = far[:, p, None] * centroid_far[None, :, s], far[:, s, None] * centroid_far[None, :, p]
        np.maximum(low, (np.abs(a - b) - 1e-10 * (a + b)) / apart, out=low)
    return np.maximum(low * (1 - 1e-9), 0)


def squared(x: np.ndarray, centroid: list[int], plain: bool) -> np.ndarray:
    """Exact squared distances of the rows of x, as doubles if they hold them, else as Python's whole numbers."""
    if plain:
        return ((x - np.array(centroid, np.float64)) ** 2).sum(1)
    return np.array([sum((int(a) - c) ** 2 for a, c in zip(row, centroid)) for row in x.tolist()], object)


def assign(x: np.ndarray, far: np.ndarray, centroids: list[list[int]], centroid_far: np.ndarray, pivots: np.ndarray):
    """(nearest centroid, its squared distance, distances measured) for each row; ties go to the smaller number."""
    limit = _plain(x.shape[1])
    plain = np.abs(x).max(initial=0) < limit and max(map(abs, sum(centroids, [])), default=0) < limit
    # beyond that size the products of the bounds may leave the range of doubles, and everything is measured
    low = lower_bounds(far, centroid_far, pivots) if plain else np.zeros((len(x), len(centroids)))
    guess = low.argmin(1)
    best = np.empty(len(x), np.float64 if plain else object)
    nearest = guess.copy()
    for c in np.unique(guess):
        own = guess == c
        best[own] = squared(x[own], centroids[c], plain)
    measured = len(x)
    for c, centroid in enumerate(centroids):
        open_ = np.flatnonzero((guess != c) & ((low[:, c] ** 2 <= best * (1 + 1e-9)) if plain else True))
        if not len(open_):
            continue
        measured += len(open_)
        d = squared(x[open_], centroid, plain)
        better = (d < best[open_]) | ((d == best[open_]) & (c < nearest[open_]))
        hit = open_[better.astype(bool)]
        best[hit], nearest[hit] = d[better.astype(bool)], c
    return nearest, best, measured


def _digits(number: int) -> list[int]:
    """Digits to base 2^30 that carry the sign; none for zero."""
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest & ((1 << _DIGIT) - 1)))
        rest >>= _DIGIT
    return out


def _number(digits: dict[int, int]) -> int:
    return sum(value << (_DIGIT * place) for place, value in digits.items())


_SUMS = "cluster int, component int, place int, value long"


def _added(sums: DataFrame) -> dict[tuple[int, int], int]:
    """(cluster, component) -> exact sum; the driver gets clusters x components x digits rows."""
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.groupBy("cluster", "component", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault((r["cluster"], r["component"]), {})[r["place"]] = r["value"]
    return {key: _number(digits) for key, digits in found.items()}


def _digit_rows(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    rows = [(c, j, place, v) for (c, j), total in totals.items() for place, v in enumerate(_digits(total))]
    columns = list(zip(*rows)) if rows else [[]] * 4
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["cluster", "component", "place", "value"])


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[list[int]], dict]:
    """vectors (vec_id, embedding) -> (vec_id, cluster, distance), the final centroids, and what was measured.

    The third value says how many distances were measured of how many there are.
    """
    spark, width = vectors.sparkSession, settings.width
    clean = keep(quantised(vectors, settings), "centroid-vectors")
    first = clean.orderBy("start", "v").limit(settings.clusters).collect()
    centroids = [[int(a) for a in np.frombuffer(r["v"], "<f8")] for r in first]
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {id_type}, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], shape), [], {"measured": 0, "of": 0}
    drawn = clean.orderBy(F.xxhash64("start"), "start", "v").limit(settings.sample).select("v").collect()
    # vectors beyond the range of plain arithmetic make no pivots
    sample = [v for v in (np.frombuffer(r["v"], "<f8") for r in drawn) if np.abs(v).max(initial=0) < _plain(width)]
    pivots = choose_pivots(np.array(sample), settings.pivots) if sample else np.zeros((0, width))

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                far = distances(matrix(batch.column("v").to_pylist(), width), pivots)
            rows = pa.array([r.astype("<f8").tobytes() for r in far], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), rows], ["vec_id", "v", "far"])

    table = keep(clean.select("vec_id", "v").mapInArrow(with_distances, f"vec_id {id_type}, v binary, far binary"), "centroid-distances")

    def placed(batch: pa.RecordBatch, centroids, centroid_far):
        x = matrix(batch.column("v").to_pylist(), width)
        return x, *assign(x, matrix(batch.column("far").to_pylist(), len(pivots)), centroids, centroid_far, pivots)

    def known() -> tuple[list[list[int]], np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            return centroids, distances(np.array([[float(a) for a in c] for c in centroids]), pivots)

    def sums(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int], int] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, nearest, _, measured = placed(batch, *of)
                totals[-1, 0] = totals.get((-1, 0), 0) + measured
                plain = np.abs(x).max(initial=0) < _plain(width)
                for c in np.unique(nearest).tolist():
                    own = x[nearest == c]
                    # sums of a batch of plain components are exact in doubles
                    added = own.sum(0).tolist() if plain and len(own) < 2**26 else [sum(map(int, col)) for col in own.T.tolist()]
                    for j, value in enumerate(added):
                        totals[c, j] = totals.get((c, j), 0) + int(value)
                    totals[c, width] = totals.get((c, width), 0) + len(own)
            yield _digit_rows(totals)

        return run

    measured = of = 0
    for _ in range(settings.rounds):
        found = _added(table.mapInArrow(sums(known()), _SUMS))
        for c in range(len(centroids)):
            if count := found.get((c, width), 0):
                centroids[c] = [found.get((c, j), 0) // count for j in range(width)]
                of += count * len(centroids)
        measured += found.get((-1, 0), 0)
    last = known()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, nearest, best, _ = placed(batch, *last)
                cut = [min(int(d), _LONGEST) for d in best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(cut, pa.int64())], ["vec_id", "cluster", "distance"]
                )

    return keep(table.mapInArrow(final, shape), "centroid-members"), centroids, {"measured": measured, "of": of}


def with_inertia(members: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia (cut to a long) and the digest of each member's centroid."""
    spark = members.sparkSession
    totals = {
        r["cluster"]: int(r["total"])
        for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    everything = min(sum(totals.values()), _LONGEST)
    # one row per cluster
    facts = spark.createDataFrame(
        [(c, min(total, _LONGEST), everything, centroid_digest(centroids[c])) for c, total in totals.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return members.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
