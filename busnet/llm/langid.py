"""Language identification in two steps: the family, then the language within it.

Features are hashed counts of letter 1- to 4-grams (words padded by a space), square-rooted and scaled
to length one.  A linear support vector machine for each pair of families decides the family by
votes; one for each pair of languages of that family decides the language.  The machines are fitted
by dual coordinate descent on a bounded sample of labelled rows (`Settings.sample` per language,
chosen by a hash of doc_id); nothing else depends on a sample.

`least_score` gives a cutoff for the confidence that texts of a known language hardly ever fall below.

Rows: `und` with score 0 if the text is null or has no letter.  A document of any length is read
whole, in pieces.  Rows with a null lang are not learned from.  With one language only, that one is
predicted.  Repeated rows are each predicted, and learned from if drawn; columns of the names lang_pred and score are
replaced, all others pass through.  An empty table gives none, and no model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from busnet.llm import hashing
from busnet.session import keep

#: Families of the languages known by code; any other language is its own family.
FAMILY = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 12
    longest: int = 4
    #: Labelled rows of a language that are learned from at most.
    sample: int = 400
    cost: float = 4.0
    epochs: int = 12
    #: Code points of a text looked at together.
    piece: int = 1 << 19
    #: Ids of the sample that are broadcast at most; more (thousands of languages) are joined by a shuffle.
    most_ids: int = 1 << 20


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter (others are tested by str.isalpha)."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)]))
    return _letters[0]


def features(text: str | None, settings: Settings) -> np.ndarray | None:
    """Unit vector of hashed n-grams; None without letters."""
    if not text:
        return None
    size = 1 << settings.bits
    total = np.zeros(size)
    table = _letter_table()
    some = False
    for at in range(0, len(text), settings.piece):
        points = np.frombuffer(text[at : at + settings.piece].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[np.minimum(points, 0xFFFF)]
        high = np.flatnonzero(points > 0xFFFF)
        letter[high] = [chr(c).isalpha() for c in points[high].tolist()]
        if not letter.any():
            continue
        some = True
        # one space between words, none doubled
        masked = np.where(letter, points, 32).astype(np.uint64)
        masked = masked[letter | np.concatenate([[True], letter[:-1]])]
        masked = np.concatenate([[np.uint64(32)], masked, [np.uint64(32)]])
        gram = np.zeros(len(masked), np.uint64)
        for n in range(1, settings.longest + 1):
            if len(masked) < n:
                break
            gram = gram[: len(masked) - n + 1] * np.uint64(0x100000001B3) + masked[n - 1 :]
            slot = ((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - settings.bits)
            total += np.bincount(slot.astype(np.int64), minlength=size)
    if not some:
        return None
    root = np.sqrt(total)
    return (root / np.linalg.norm(root)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights of an L2-loss linear machine with y in -1, 1 (dual coordinate descent); classes weigh the same."""
    n = len(y)
    share = {s: n / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    diagonal = np.array([0.5 / (settings.cost * share[s]) for s in y.tolist()])
    squared = (x * x).sum(1) + diagonal
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(settings.epochs):
        for i in order.permutation(n):
            slope = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / squared[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Votes:
    """One machine for each pair of classes; the most votes win, then the larger sum of margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, settings: Settings):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        machines = []
        for a, b in self.pairs:
            mine = np.isin(labels, [self.classes[a], self.classes[b]])
            machines.append(train_svm(x[mine], np.where(labels[mine] == self.classes[a], 1, -1), settings))
        self.weights = np.array(machines, np.float32).reshape(len(machines), x.shape[1])

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the class, confidence 0 to 1) of each row."""
        votes = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = np.tanh(x @ self.weights.T)
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += (margin[:, k] > 0) + 0.01 * margin[:, k]
            votes[:, b] += (margin[:, k] <= 0) - 0.01 * margin[:, k]
        best = votes.argmax(1)
        sure = np.ones(len(x))
        for k, (a, b) in enumerate(self.pairs):
            for side, sign in ((a, 1), (b, -1)):
                sure = np.where(best == side, np.minimum(sure, 1 / (1 + np.exp(-4 * sign * margin[:, k]))), sure)
        return best, sure


class Model:
    def __init__(self, x: np.ndarray, languages: np.ndarray, settings: Settings):
        self.settings = settings
        families = np.array([FAMILY.get(v, f"own-{v}") for v in languages.tolist()])
        self.family = Votes(x, families, settings)
        self.within = [Votes(x[families == f], languages[families == f], settings) for f in self.family.classes]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors = [features(t, self.settings) for t in texts]
        known = [i for i, v in enumerate(vectors) if v is not None]
        if not known:
            return names, scores
        x = np.array([vectors[i] for i in known])
        family, sure = self.family.decide(x)
        for f, votes in enumerate(self.within):
            mine = np.flatnonzero(family == f)
            if len(mine):
                language, surer = votes.decide(x[mine])
                for i, k, s in zip(mine, language, surer):
                    names[known[i]] = votes.classes[k]
                    scores[known[i]] = min(float(sure[i]), float(s))
        return names, scores


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from (doc_id, text, lang); None if there is nothing to learn from.

    The sample is taken before texts are moved: ids first, then the texts of those ids.
    """
    drawn = F.xxhash64("doc_id")
    # the best of each slice first, so that no task gets a whole language
    some = labelled.filter("lang IS NOT NULL").select("doc_id", "lang", drawn.alias("draw"))
    first = W.partitionBy("lang", F.pmod("draw", F.lit(64))).orderBy("draw", "doc_id")
    every = W.partitionBy("lang").orderBy("draw", "doc_id")
    ids = (
        some.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= settings.sample)
        .withColumn("at", F.row_number().over(every)).filter(F.col("at") <= settings.sample)
        .select("doc_id", "lang").distinct()
    )
    # the ids are few (a sample for each language), and counted before they go to every task
    ids = keep(ids, "language-sample")
    chosen = labelled.select("doc_id", "text", "lang").join(
        F.broadcast(ids) if ids.count() <= settings.most_ids else ids, ["doc_id", "lang"], "left_semi"
    )

    def run(batches):
        for batch in batches:
            rows = [
                (lang, v) for lang, v in zip(
                    batch.column("lang").to_pylist(), (features(t, settings) for t in batch.column("text").to_pylist())
                ) if v is not None
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.float16).tobytes() for r in rows], pa.binary())], ["lang", "x"]
            )

    rows = chosen.mapInArrow(run, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    learned = sorted(zip(rows["lang"].to_pylist(), rows["x"].to_pylist()))  # whatever order the tasks ended in
    x = np.array([np.frombuffer(v, np.float16) for _, v in learned], np.float32)
    return Model(x, np.array([lang for lang, _ in learned]), settings)


def _tail(n: int, k: int, share: float) -> float:
    """P(Bin(n, share) <= k)."""
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(share) + (n - j) * math.log1p(-share)
    return math.fsum(math.exp(log(j)) for j in range(k + 1))


def least_score(labelled: DataFrame, model: Model | None, risk: float = 0.001, level: float = 0.05) -> float:
    """The greatest score, in steps of a thousandth, below which a text of known language falls with at most `risk`.

    labelled (doc_id, text, lang) must be rows the model has not learned from; those that it names rightly count.
    The bound is an exact binomial one and holds with probability 1 - level; 0 if there are too few rows to give any.
    """
    scored = predict(labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL"), model)
    step = F.floor(F.col("score") * 1000).cast("int")
    counts = {r["step"]: r["n"] for r in scored.filter("lang = lang_pred").groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    n, k, found = sum(counts.values()), 0, 0
    for s in range(1, 1001):
        k += counts.get(s - 1, 0)
        if k >= n * risk or _tail(n, k, risk) > level:
            break
        found = s
    return found / 1000


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score; other columns stay (own columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [], []
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                n, s = shared.value.predict(part) if shared.value else ([UNKNOWN] * len(part), np.zeros(len(part)))
                names += n
                scores += list(s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")
