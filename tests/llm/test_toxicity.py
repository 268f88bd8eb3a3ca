"""Toxicity scores and passages against a plain version with strings instead of slots."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from busnet.llm import toxicity

SETTINGS = toxicity.Settings()


def features(token):
    return [token] + [token[:k] if len(token) > k else None for k in SETTINGS.beginnings]


def plain_tokens(text):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer("[A-Za-z0-9]+", text or "")]


def weights(labelled):
    """Score of a token from counts of strings: its most specific known feature, less the drift."""
    count = [Counter(), Counter()]
    for text, toxic in labelled:
        for _, _, t in plain_tokens(text):
            count[toxic].update((k, f) for k, f in enumerate(features(t)) if f is not None)
    totals = [sum(c.values()) for c in count]

    def odds(feature):
        c = [side[feature] for side in count]
        prior = SETTINGS.prior * (sum(c) + 0.01)
        weight = SETTINGS.prior * (sum(totals) + 0.01 * SETTINGS.slots)
        log = [math.log((x + prior) / (t + weight - x - prior)) for x, t in zip(c, totals)]
        error = SETTINGS.doubt * math.sqrt(sum(1 / (x + prior) for x in c))
        value = math.copysign(max(0.0, abs(log[1] - log[0]) - error), log[1] - log[0])
        return value, value != 0 or error < SETTINGS.known

    def score(token):
        for k, f in enumerate(features(token)):
            if f is not None:
                value, known = odds((k, f))
                if known:
                    return value - SETTINGS.drift
        return -SETTINGS.drift

    return score


def maximal(scores):
    """Maximal scoring segments by their definition: the best one, then the same left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a = -best[2]
    b = a - best[1]
    right = maximal(scores[b:])
    return maximal(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, w) for x, y, w in right]


def test_scores_and_passages(spark):
    rng = random.Random(21)
    calm, harsh = [f"calm{i}" for i in range(60)], [f"harsh{i}" for i in range(12)]

    def text(toxic, parts=1):
        words = []
        for _ in range(parts):
            words += [rng.choice(calm) for _ in range(rng.randint(6, 14))]
            if toxic:
                words += [rng.choice(harsh) for _ in range(rng.randint(3, 6))]
        return " ".join(words + [rng.choice(calm)])

    labelled = [(text(t), t) for t in [rng.random() < 0.3 for _ in range(400)] for t in [int(t)]]
    model = toxicity.fit(spark.createDataFrame(labelled, "text string, toxic int"))
    long = "calm1 " * 200000 + "Harsh1 harsh2 HARSH3 harsh4 harsh5 harsh6 " + "calm2 " * 1000
    rows = [(i, text(i % 2, 1 + i % 4)) for i in range(40)] + [(90, None), (91, ""), (92, " .,!"), (93, "é harsh1 harsh2"), (None, text(1)), (5, text(0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("x")).withColumn("best", F.lit(1))
    found = {(r.doc_id, round(r.score, 9), r.n_passages) for r in toxicity.score(docs, model).collect()}
    spans = {(r.doc_id, r.start, r.end) for r in toxicity.passages(docs, model).collect()}
    score, wanted, places = weights(labelled), set(), set()
    several = 0
    for doc, t in rows:
        if doc == 93:
            continue  # bytes beyond ASCII are part of tokens
        tokens = plain_tokens(t)
        segments = maximal([score(x) for _, _, x in tokens])
        evidence = [toxicity._minus_log_p(math.log(model.k * len(tokens)) - model.rate * w) for _, _, w in segments]
        curve = model.curve[0] + model.curve[1] * max(evidence, default=0.0)
        passages = [s for s, e in zip(segments, evidence) if e >= -math.log(SETTINGS.significant)]
        several += len(passages) > 1
        wanted.add((doc, round(1 / (1 + math.exp(-curve)), 9), len(passages)))
        places |= {(doc, tokens[a][0], tokens[b - 1][1]) for a, b, _ in passages}
    near = lambda a, b: a[0] == b[0] and a[2] == b[2] and a[1] == pytest.approx(b[1], abs=1e-5)
    assert several > 5
    assert all(any(near(w, f) for f in found) for w in wanted)
    assert {s for s in spans if s[0] != 93} == places
    # a passage far inside a long text
    deep = spark.createDataFrame([(1, long)], "doc_id long, text string")
    [place] = toxicity.passages(deep, model).collect()
    assert long[place.start : place.end].lower().split() == [f"harsh{i}" for i in range(1, 7)]
    assert toxicity.score(docs.limit(0), model).count() == toxicity.passages(docs.limit(0), model).count() == 0
