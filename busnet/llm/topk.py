"""Exact top-k inner products with a pivot table.

For vectors q and x, <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2.  Distances of every vector to many pivots
are computed once; by the triangle inequality the greatest |d(q, p) - d(x, p)| over the pivots is a
lower bound of d(q, x) and gives an upper bound of the product.  Vectors are put in blocks in the order of their
nearest pivot, and every block, and every cell of 128 vectors inside it, carries its least and greatest
distance to each pivot.  A block of queries meets a block of rows only if that interval bound reaches the least
k-th best score known for its queries; this is decided from the intervals, before any vector is moved.  Inside, the
cells are evaluated in the order of their bounds until no bound is left that reaches the k-th best score of a query, which
no later candidate can then reach.  Scores are exact; pivots and the first k-th best come from a sample of
fixed size, which affects only how early the search stops.

A task holds two blocks, and nothing is broadcast but pivots and sample.  Where distances tell little (independent
components in many dimensions) no bound rules anything out and the search compares all queries with all rows.

Rows: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id.
Shorter vectors count as padded with zeros, empty ones too.  Fully equal rows count once; a query never meets rows of its own id.
Ties go to the smaller id.  Scores beyond 64 bits are cut to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from busnet.session import keep


@dataclass(frozen=True)
class Settings:
    k: int = 20
    scale: float = 64.0
    pivots: int = 32
    #: Vectors that pivots and first thresholds are drawn from.
    sample: int = 1024
    block: int = 4096
    cell: int = 128


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """(id, embedding) -> (id, v): floor(scale * x) as little-endian doubles; unfit vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("embedding")):
                values = x.values
                if values is None or values.null_count or i is None:
                    continue
                v = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    ids.append(i)
                    found.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "v"])

    return vectors.mapInArrow(run, "id long, v binary")


def matrix(column: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for row, raw in zip(out, column):
        v = np.frombuffer(raw)
        row[: len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the vector farthest from those before it."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether doubles hold all inner products of rows of x with rows of q, and the sums on the way."""
    return np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2.0**53


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers, rows of q by rows of x."""
    if _exact(x, q):
        return (q @ x.T).astype(np.int64)
    limit = 2**63 - 1
    rows, whole = x.tolist(), q.tolist()
    exact = [[sum(int(a) * int(b) for a, b in zip(row, own)) for row in rows] for own in whole]
    return np.array([[min(max(v, -limit - 1), limit) for v in row] for row in exact], np.int64).reshape(len(q), len(x))


class Intervals:
    """Least and greatest distances to the pivots of groups of vectors, and their greatest square norms."""

    def __init__(self, low: np.ndarray, high: np.ndarray, norm: np.ndarray):
        self.low, self.high, self.norm = low, high, norm

    @classmethod
    def of(cls, x: np.ndarray, far: np.ndarray, heads: np.ndarray) -> Intervals:
        """Of the groups of rows that begin at heads."""
        return cls(np.minimum.reduceat(far, heads), np.maximum.reduceat(far, heads), np.maximum.reduceat((x * x).sum(1), heads))

    def bounds(self, other: Intervals) -> np.ndarray:
        """Upper bounds of the products, groups of self by groups of other, rounded up by more than the arithmetic errs."""
        low = np.zeros((len(self.norm), len(other.norm)))
        for p in range(self.low.shape[1]):
            np.maximum(low, other.low[None, :, p] - self.high[:, p, None], out=low)
            np.maximum(low, self.low[:, p, None] - other.high[None, :, p], out=low)
        slack = 1e-9 * (np.abs(self.high).max(initial=0) + np.abs(other.high).max(initial=0))
        low = np.maximum(low - slack, 0)
        bound = (self.norm[:, None] + other.norm[None, :] - low * low) / 2
        return np.floor(bound + 1e-9 * (self.norm[:, None] + other.norm[None, :]) + 1e-6)


def _least_of(k: int, best: tuple[np.ndarray, ...], floor: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The k best (query place, id, score) of each query, and its new k-th best score."""
    place, ids, score = best
    order = np.lexsort((ids, -score, place))
    place, ids, score = place[order], ids[order], score[order]
    count = np.bincount(place, minlength=len(floor))
    start = np.cumsum(count) - count
    rank = np.arange(len(place)) - start[place]
    floor = floor.copy()
    full = np.flatnonzero(count >= k)
    floor[full] = np.maximum(floor[full], score[start[full] + k - 1])
    held = (rank < k) & (score >= floor[place])
    return (place[held], ids[held], score[held]), floor


def best_of_block(q_ids, q, q_far, floor, ids, x, x_far, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): up to k best rows of a block for each query, none that k others of the corpus beat."""
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = [(none, none, none)]
    cells = np.arange(0, len(x), settings.cell)
    of_cells = Intervals.of(x, x_far, cells)
    exact = _exact(x, q)
    for at in range(0, len(q), 64):
        part, own_ids, least = q[at : at + 64], q_ids[at : at + 64], floor[at : at + 64]
        each = np.arange(len(part))
        bound = Intervals.of(part, q_far[at : at + 64], each).bounds(of_cells)
        best = (none, none, none)
        order = np.argsort(-bound.max(0), kind="stable")
        done, step = 0, 2
        while done < len(order):
            # the next cells in bound order, for the queries that any of them may still serve
            some = order[done : done + step]
            open_ = bound[:, some] >= least[:, None]
            asked = np.flatnonzero(open_.any(1))
            done, step = done + step, min(2 * step, 16)
            if not len(asked):
                if (bound[:, order[done:]] < least[:, None]).all():
                    break
                continue
            some = some[open_.any(0)]
            rows = np.concatenate([np.arange(c * settings.cell, min((c + 1) * settings.cell, len(x))) for c in some])
            score = part[asked] @ x[rows].T if exact else products(x[rows], part[asked])
            hit = score >= least[asked, None]
            hit &= ids[rows][None, :] != own_ids[asked, None]
            i, j = np.nonzero(hit)
            if len(i):
                more = (asked[i], ids[rows[j]], score[i, j].astype(np.int64))
                best, least = _least_of(settings.k, tuple(np.concatenate(c) for c in zip(best, more)), least)
        found.append((own_ids[best[0]], *best[1:]))
    return tuple(np.concatenate(c) for c in zip(*found))


#: Blocks whose intervals are compared in one task.
_SUMMARIES = 1024
_PACKED = "block long, ids binary, v binary, far binary, floor binary, low binary, high binary, norm double, least long"


def _arrays(row: dict, width: int):
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["v"]).reshape(len(ids), width), np.frombuffer(row["far"]).reshape(len(ids), -1), np.frombuffer(row["floor"], np.int64)


def meetings(queries: DataFrame, rows: DataFrame, query_blocks: int, row_blocks: int) -> DataFrame:
    """(q, r): blocks of queries and of rows whose intervals leave room for a result."""
    shape = ["block", "low", "high", "norm", "least"]

    def tiles(df: DataFrame, side: int, others: int) -> DataFrame:
        mine = F.floor(F.col("block") / _SUMMARIES).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), F.lit((others - 1) // _SUMMARIES)))
        a, b = (mine.alias("q_tile"), all_others.alias("r_tile")) if side else (all_others.alias("q_tile"), mine.alias("r_tile"))
        return df.select(a, b, F.lit(side).alias("side"), *shape)

    def meet(group: pa.Table) -> pa.Table:
        sides = []
        for side in (1, 0):
            part = group.filter(pa.compute.equal(group["side"], side))
            low, high = (np.array([np.frombuffer(v) for v in part[c].to_pylist()]) for c in ("low", "high"))
            sides.append((part, Intervals(low, high, part["norm"].to_numpy())))
        (asked, of_queries), (held, of_rows) = sides
        if not (asked.num_rows and held.num_rows):
            return pa.table({"q": pa.array([], pa.int64()), "r": pa.array([], pa.int64())})
        i, j = np.nonzero(of_queries.bounds(of_rows) >= asked["least"].to_numpy()[:, None])
        return pa.table({"q": asked["block"].to_numpy()[i], "r": held["block"].to_numpy()[j]})

    both = tiles(queries, 1, row_blocks).unionByName(tiles(rows, 0, query_blocks))
    return both.groupBy("q_tile", "r_tile").applyInArrow(meet, "q long, r long")


def search(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """vectors (id, embedding) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    clean = keep(quantised(vectors.select("id", "embedding"), settings.scale).distinct(), "topk-vectors")
    widest = clean.agg(F.max(F.length("v"))).first()[0]
    width = max(1, (widest or 0) // 8)
    drawn = clean.orderBy(F.xxhash64("id"), "id", "v").limit(settings.sample).toArrow()
    sample_ids, sample = drawn["id"].to_numpy(), matrix(drawn["v"].to_pylist(), width)
    pivots = choose_pivots(sample, settings.pivots) if len(sample) else sample
    known = spark.sparkContext.broadcast((sample_ids, sample, pivots))
    k, none = settings.k, -(2**63)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = distances(matrix(batch.column("v").to_pylist(), width), known.value[2]).argmin(1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "v", "cell"])

    placed = keep(clean.mapInArrow(nearest, "id long, v binary, cell int"), "topk-placed")
    counts = {
        r["cell"]: (r["n"], r["asked"])  # one row per pivot
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked")).collect()
    }

    def pack(side: int):
        """One row per block: ids, vectors, distances to the pivots, first thresholds of queries, and their intervals."""

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("cell")
            ids, x = group["id"].to_numpy(), matrix(group["v"].to_pylist(), width)
            some_ids, some, pivots = known.value
            far = distances(x, pivots)
            floor = np.full(len(ids), none)
            if side and len(some) >= k:
                for at in range(0, len(ids), 256):
                    # distinct ids, so that the k-th best of the sample is a k-th best of the corpus
                    score = products(some, x[at : at + 256])
                    own = some_ids[None, :] == ids[at : at + 256, None]
                    score[own] = none
                    floor[at : at + 256] = np.where(len(some) - own.sum(1) >= k, np.partition(score, -k, 1)[:, -k], none)
            every = Intervals.of(x, far, np.zeros(1, np.int64))
            return pa.table({
                "block": group["block"][:1], "ids": [ids.tobytes()], "v": [x.tobytes()], "far": [far.tobytes()], "floor": [floor.astype(np.int64).tobytes()],
                "low": [every.low[0].tobytes()], "high": [every.high[0].tobytes()], "norm": pa.array([every.norm[0]]), "least": pa.array([floor.min()], pa.int64()),
            })

        return run

    def blocks(df: DataFrame, side: int) -> tuple[DataFrame, int]:
        """Blocks in the order of nearest pivots; the vectors of one pivot are spread evenly over its part of them."""
        before, at = 0, F.lit(0.0)
        for cell in sorted(counts):
            spread = F.lit(float(before)) + F.lit(float(counts[cell][side])) * F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / (1 << 30)
            at = F.when(F.col("cell") == cell, spread).otherwise(at)
            before += counts[cell][side]
        numbered = df.withColumn("block", F.floor(at / settings.block).cast("long"))
        return keep(numbered.groupBy("block").applyInArrow(pack(side), _PACKED), "topk-blocks"), max(1, -(-before // settings.block))

    rows, row_blocks = blocks(placed, 0)
    queries, query_blocks = blocks(placed.filter(is_query), 1)
    pairs = keep(meetings(queries, rows, query_blocks, row_blocks), "topk-meetings")
    shape = ["side", "ids", "v", "far", "floor"]
    meet = rows.withColumn("side", F.lit(0)).join(pairs, F.col("block") == F.col("r")).select("r", "q", *shape).unionByName(
        queries.withColumn("side", F.lit(1)).join(pairs, F.col("block") == F.col("q")).select("r", "q", *shape)
    )

    def compare(group: pa.Table) -> pa.Table:
        sides = {row["side"]: _arrays(row, width) for row in group.to_pylist()}
        ids, x, x_far, _ = sides[0]
        q_ids, q, q_far, floor = sides[1]
        found = best_of_block(q_ids, q, q_far, floor, ids, x, x_far, settings)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found)})

    met = meet.groupBy("r", "q").applyInArrow(compare, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
