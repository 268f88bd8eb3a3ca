"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased; a token and its
beginnings of a few letters are hashed to a fixed number of slots.  A token scores by the most specific
of these that is known well enough, so inflected forms never seen before take after their stem.  Log-odds between toxic and clean documents carry a Dirichlet prior in proportion to
the whole training corpus (Monroe, Colaresi and Quinn, 2008) and are pulled to zero by their
standard error, so a word seen a few times says nothing.  Each token scores its log-odds less a
drift; all maximal scoring segments of a document are found in one linear scan (Ruzzo and Tompa,
1999).  The best segment's score S among n tokens gets the extreme-value probability
1 - exp(-K n exp(-lambda S)) (Karlin and Altschul, 1990), lambda and K from clean documents; a
two-parameter logistic curve over minus its logarithm turns it into a score from 0 to 1.  Every segment whose own
probability is at most `significant` is a passage; `score` counts them and `passages` gives their spans.

K and the curve come from labelled documents scored by the counts of the others, so they hold for new
ones.  Counts, K and the curve use all labelled rows given; what tasks and driver hold is bounded by `slots`
and `bins`.  Features that share a slot are counted together.

Rows: repeated rows are each scored, and learned from; columns other than doc_id and text are not read.  Null and empty texts have no segment and get the score of such documents.  Rows with
a null label are not learned from; without rows of both classes every score is the share of toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from busnet.llm import arrow, hashing


@dataclass(frozen=True)
class Settings:
    slots: int = 1 << 20
    #: Code points of the beginnings, most specific first.
    beginnings: tuple[int, ...] = (10, 8, 7, 6, 5, 4, 3)
    #: A slot is known if its standard errors (times doubt) are below this.
    known: float = 1.5
    #: Weight of the prior against the training tokens.
    prior: float = 0.05
    #: Standard errors by which log-odds are pulled to zero.
    doubt: float = 1.0
    #: What a token costs a segment; above the log-odds that all words of a language share if it has more
    #: toxic documents than others.
    drift: float = 1.0
    bins: int = 1024
    #: Largest extreme-value probability of a significant passage.
    significant: float = 0.01


#: Bytes that are no part of a token.
_GAP = np.ones(256, bool)
_GAP[128:] = False
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    _GAP[ord(_low) : ord(_high) + 1] = False


def tokens(block: pa.RecordBatch, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots of each token, one row a level; first token of each document and the end; byte starts; byte ends).

    The first level is the whole token, the others its beginnings (-1 where the token is no longer than that).
    """
    data, offsets = arrow.utf8(block.column("text"))
    starts, ends = hashing.word_bounds(data, offsets, _GAP)
    slots = np.full((1 + len(settings.beginnings), len(starts)), -1, np.int64)
    if not len(starts):
        return slots, np.zeros(len(offsets), np.int64), starts, ends
    lower = hashing.LOWER[data]
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
    first = np.searchsorted(lead, starts)
    size = np.uint64(settings.slots)
    slots[0] = (hashing.pieces(lower, starts, ends) % size).astype(np.int64)
    for level, points in enumerate(settings.beginnings, 1):
        stop = lead[np.minimum(first + points, len(lead) - 1)]
        longer = (first + points < len(lead)) & (stop < ends)
        part = hashing.pieces(lower, starts[longer], stop[longer]) + np.uint64(points * 0x10001)
        slots[level, longer] = (hashing.mix(part) % size).astype(np.int64)
    return slots, np.searchsorted(starts, offsets), starts, ends


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in order, in linear time.

    A list of disjoint candidates with the sums before and at their ends; a new positive token either
    joins candidates to its left that a larger sum justifies or becomes one itself.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, earlier one with less before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _decide(slots: np.ndarray, scores: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Score of each token by its most specific known level."""
    out = np.zeros(slots.shape[1])
    for level in slots[::-1]:
        decides = (level >= 0) & known[level]
        out[decides] = scores[level[decides]]
    return out


@dataclass
class Model:
    settings: Settings
    scores: np.ndarray  # of each slot, without the drift
    known: np.ndarray  # whether the slot decides
    rate: float  # lambda
    k: float
    curve: tuple[float, float]

    def weigh(self, slots: np.ndarray) -> np.ndarray:
        """Score of each token, the drift taken off."""
        return _decide(slots, self.scores, self.known) - self.settings.drift

    def evidence(self, best: float, n: int) -> float:
        """Minus the natural logarithm of the extreme-value probability, at most 600."""
        if best <= 0 or not n:
            return 0.0
        return _minus_log_p(np.log(self.k * n) - self.rate * best)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -500, 500)))


def _minus_log_p(log_expected: float) -> float:
    """-ln(1 - exp(-e^x)) with e^x expected segments by chance, from 0 to 600."""
    if log_expected < -30:
        return float(min(600.0, -log_expected))
    return float(min(600.0, max(0.0, -np.log(-np.expm1(-np.exp(min(log_expected, 50.0)))))))


def _counts(labelled: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each slot in clean and toxic documents, and the number of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, settings.slots + 1), np.int64)  # the last column counts documents
        for batch in batches:
            for block in arrow.blocks(batch):
                slots, first, _, _ = tokens(block, settings)
                toxic = block.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                side = np.repeat(toxic, np.diff(first)) * (settings.slots + 1)
                where, n = np.unique((slots + side)[slots >= 0], return_counts=True)
                count.ravel()[where] += n
                count[:, -1] += np.bincount(toxic, minlength=2)
        where = np.flatnonzero(count.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(count[0, where]), pa.array(count[1, where])], ["slot", "clean", "toxic"])

    rows = labelled.mapInArrow(run, "slot long, clean long, toxic long").groupBy("slot").sum("clean", "toxic").toArrow()
    count = np.zeros((2, settings.slots + 1), np.int64)
    where = rows.column(0).to_numpy()
    count[0, where], count[1, where] = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    return count[:, :-1], count[:, -1]


def log_odds(count: np.ndarray, totals: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of slots with these counts (clean and toxic row), pulled to zero, and whether they are known well enough.

    totals: tokens of the clean and the toxic documents.
    """
    prior = settings.prior * (count.sum(0) + 0.01)
    weight = settings.prior * (totals.sum() + 0.01 * settings.slots)
    side = [np.log((c + prior) / (t + weight - c - prior)) for c, t in zip(count, totals)]
    odds = side[1] - side[0]
    error = settings.doubt * np.sqrt(1 / (count[0] + prior) + 1 / (count[1] + prior))
    out = np.sign(odds) * np.maximum(0, np.abs(odds) - error)
    return out, (out != 0) | (error < settings.known)


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1, for a negative mean score."""
    if not (scores[share > 0] > 0).any():
        return 1.0
    low, high = 0.0, 1e-3
    value = lambda rate: float((share * np.exp(np.minimum(rate * scores, 700))).sum())
    while value(high) < 1:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return high


def _heaviest(scores: np.ndarray) -> float:
    return max((w for _, _, w in segments(scores)), default=0.0) if (scores > 0).any() else 0.0


def _found(block: pa.RecordBatch, model: Model) -> Iterator[tuple[list[tuple[int, int, float, float]], int, int]]:
    """(segments as first token, last token and one, weight, evidence; first token; tokens) of each document."""
    slots, first, _, _ = tokens(block, model.settings)
    scores = model.weigh(slots)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        own = scores[a:b]
        found = segments(own) if (own > 0).any() else []
        yield [(x, y, w, model.evidence(w, b - a)) for x, y, w in found], a, b - a


def _best_without_own(block: pa.RecordBatch, count: np.ndarray, settings: Settings) -> Iterator[tuple[float, int]]:
    """(weight of the best segment, tokens) of the labelled documents themselves, each by the counts of all the others."""
    slots, first, _, _ = tokens(block, settings)
    totals = count.sum(1)
    for toxic, a, b in zip(block.column("toxic").to_pylist(), first, first[1:]):
        own = slots[:, a:b]
        distinct, where, n = np.unique(own, return_inverse=True, return_counts=True)
        others = count[:, distinct].astype(np.float64)
        others[toxic] -= n * (distinct >= 0)
        left = totals.astype(np.float64)
        left[toxic] -= (own >= 0).sum()
        scores, known = log_odds(np.maximum(others, 0), left, settings)
        local = np.where(own >= 0, where.reshape(own.shape), -1)
        yield _heaviest(_decide(local, scores, known) - settings.drift), int(b - a)


def _logistic(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """Curve of the share of yes over x by Newton's method, slightly penalised; the slope is not negative."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x / 10], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (yes - (yes + no) * p) - 0.01 * w
        hessian = (design * ((yes + no) * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0]), float(max(w[1], 0.0) / 10)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from (text, toxic 0 or 1); read twice, so give a stored table."""
    labelled = labelled.filter("toxic IN (0, 1)").select("text", "toxic")
    count, documents = _counts(labelled, settings)
    scores, known = log_odds(count, count.sum(1), settings)
    share = (count[0] + 1e-3) / (count[0].sum() + 1e-3 * settings.slots)
    rate = _decay(scores - settings.drift, share) if count.any() else 1.0
    model = Model(settings, scores.astype(np.float32), known, rate, 0.1, (0.0, 0.0))
    if not documents.all():
        level = documents[1] / max(1, documents.sum())
        level = min(max(level, 1e-6), 1 - 1e-6)
        model.curve = (float(np.log(level / (1 - level))), 0.0)
        return model
    sent = labelled.sparkSession.sparkContext.broadcast(count.astype(np.int32) if count.max() < 2**31 else count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Histogram over (weight in eighths, logarithm of the tokens, class)."""
        seen: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for block in arrow.blocks(batch):
                for (best, n), toxic in zip(_best_without_own(block, sent.value, settings), block.column("toxic").to_pylist()):
                    key = (min(int(best * 8), settings.bins - 1), int(np.log2(n + 1) * 2), toxic)
                    seen[key] = seen.get(key, 0) + 1
        rows = [(*k, v) for k, v in sorted(seen.items())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["best", "size", "toxic", "n"]
        )

    table = labelled.mapInArrow(run, "best long, size long, toxic long, n long").groupBy("best", "size", "toxic").sum("n").toArrow()
    best, size, toxic, n = (table.column(i).to_numpy().astype(float) for i in range(4))
    best, size = best / 8 + (best > 0) / 16, 2 ** (size / 2)
    # K: clean documents whose best segment passes a level, per token, at that level
    clean = toxic == 0
    level = 1.0
    above = n[clean & (best > level)].sum()
    model.k = float((above + 0.5) / ((n * size)[clean].sum() + 1) * np.exp(model.rate * level))
    evidence = np.array([model.evidence(b, s) for b, s in zip(best, size)])
    model.curve = _logistic(evidence, n * toxic, n * (1 - toxic))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, best (weight of the best segment), n_passages (significant ones); one row per input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    least = -np.log(model.settings.significant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrow.blocks(batch):
                found = [f for f, _, _ in _found(block, sent.value)]
                best = [max((w for _, _, w, _ in f), default=0.0) for f in found]
                evidence = np.array([max((e for _, _, _, e in f), default=0.0) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"), pa.array(sent.value.score(evidence)), pa.array(best, pa.float64()),
                        pa.array([sum(e >= least for _, _, _, e in f) for f in found], pa.int64()),
                    ],
                    ["doc_id", "score", "best", "n_passages"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, best double, n_passages long")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start and end (UTF-8 byte offsets), weight and evidence (-ln of the probability) of each significant passage."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    least = -np.log(model.settings.significant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrow.blocks(batch):
                _, _, starts, ends = tokens(block, sent.value.settings)
                _, offsets = arrow.utf8(block.column("text"))
                rows = []
                for (found, at, _), doc, begin in zip(_found(block, sent.value), block.column("doc_id").to_pylist(), offsets):
                    for a, b, weight, evidence in found:
                        if evidence >= least:
                            rows.append((doc, int(starts[at + a] - begin), int(ends[at + b - 1] - begin), weight, evidence))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "start", "end", "weight", "evidence"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, weight double, evidence double")
