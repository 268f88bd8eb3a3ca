"""Quality rules against plain counts, and thresholds against binomial sums of fractions."""

import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from busnet.llm import quality

RULES = (quality.Rule("symbols", (300, 100, 20)), quality.Rule("shouting", (500, 100)))


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for found in places.values() if len(found) > 1 for i in found for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def tail(n, k, share):
    return sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1))


def test_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a b c", "\u0085x \x1c y", "same line\nsame line\n \nsame line ", "w " * 7, "w " * 8, "w " * 9, "#|<>" * 5, "É È a"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    block = " ".join(f"t{i}" for i in range(20))
    texts += [f"{block} x {block}", f"{block} {block} {block}", f"{block}\n{block}", "long words " + "abcdefgh " * 200000, " ".join(map(str, range(300000)))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "without an id"), (3, "one"), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("n_words", F.lit("x")).withColumn("lines", F.lit(1))
    docs = docs.withColumn("stratum", F.lit(2)).withColumn("rule", F.lit(2)).withColumn("of", F.lit(2)).withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.judge(docs, labels, F.lit(None)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in found), key=key) == sorted(((i, *counts(t)) for i, t in rows), key=key)
    for r in found:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert (r.base_failed, r.kept, r.rejected_by) == (failed, not failed, "")
    assert quality.judge(docs.limit(0), labels, F.lit("a")).count() == 0


@pytest.mark.parametrize("n,k,share", [(0, 0, 0.01), (40, 0, 0.05), (1000, 3, 0.01), (5000, 30, 0.01), (200, 2, 0.01), (100000, 900, 0.01)])
def test_binomial(spark, n, k, share):
    row = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long") + F.col("id"), F.lit(k).cast("long") + F.col("id"), share)).first()[0]
    if k >= n * share:
        assert row == 1.0
    elif n <= 1000:
        assert row == pytest.approx(float(tail(n, k, Fraction(1, round(1 / share)))), rel=1e-9)
    else:
        log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(share) + (n - j) * math.log(1 - share)
        assert row == pytest.approx(sum(math.exp(log(j)) for j in range(k + 1)), rel=1e-6)


def labelled_texts(rng, count):
    """Good texts are calm; bad ones are full of symbols in stratum a, shout in b, and look like good ones in c."""
    rows, labels = [], []
    for i in range(count):
        stratum, good = rng.choice("aab") if rng.random() < 0.9 else "c", rng.random() < 0.8
        words = [rng.choice(["calm", "words", "of", "text"]) + str(rng.randint(0, 999)) for _ in range(30)]
        if not good and stratum == "a" or good and rng.random() < 0.001:
            words = [w + rng.choice("#$%") for w in words]
        if not good and stratum == "b":
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words), stratum if rng.random() < 0.98 else None))
        if rng.random() < 0.8:
            labels.append((i, int(good)))
    return rows, labels


def test_thresholds(spark):
    rng = random.Random(8)
    rows, labels = labelled_texts(rng, 6000)
    labels += [(labels[0][0], 0), (labels[1][0], None), (None, 0), (10**9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(4)
    settings = quality.Settings(risk=0.04, rules=RULES)
    found = {r.doc_id: r for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("kind"), settings).collect()}

    worst = {}
    for i, q in labels:
        if q is not None:
            worst[i] = min(q, worst.get(i, q))
    measure = {"symbols": lambda t: 1000 * sum(c in "#*$%&|<>" for c in t) // counts(t)[1], "shouting": lambda t: 1000 * sum(c.isupper() for c in t) // counts(t)[1]}
    cells, proposed = {}, {}
    for i, text, kind in rows:
        if i not in worst:
            continue
        held = zlib.crc32(str(i).encode()) % 2
        for rule in RULES:
            for place, cut in enumerate(rule.cutoffs):
                cell = cells.setdefault((kind, rule.name), [[0, 0, 0, 0] for _ in rule.cutoffs])[place]
                hit = measure[rule.name](text) > cut
                if not held:
                    cell[0 if worst[i] == 0 else 1] += hit
                elif worst[i]:
                    cell[2] += 1
                    cell[3] += hit
    for key, grid in cells.items():
        gains = [c[0] - 5 * c[1] for c in grid]
        if max(gains) > 0:
            proposed[key] = gains.index(max(gains))
    cutoffs = {}
    for (kind, name), last in proposed.items():
        for place in range(last + 1):
            n, k = cells[kind, name][place][2:]
            if not (k < n * 0.02 and tail(n, k, 0.02) <= 0.05 / len(proposed)):
                break
            cutoffs[kind, name] = next(r for r in RULES if r.name == name).cutoffs[place]
    assert {("a", "symbols"), ("b", "shouting")} <= set(cutoffs)
    for i, text, kind in rows:
        broken = [r.name for r in RULES if (kind, r.name) in cutoffs and measure[r.name](text) > cutoffs[kind, r.name]]
        assert found[i].rejected_by == ",".join(broken)
        assert found[i].kept == (not found[i].base_failed and not broken)


def test_false_rejections_stay_below_the_risk(spark):
    """A rule that hits three of a hundred good texts is not certified at a risk of one of a hundred."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(6000):
        good = rng.random() < 0.8
        words = [f"w{rng.randint(0, 999)}" for _ in range(30)]
        if rng.random() < (0.03 if good else 0.9):
            words = [w + "#" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    strict = quality.judge(docs, table, F.lit("x"), quality.Settings(risk=0.02, rules=RULES))
    assert strict.filter("rejected_by != ''").count() == 0
    loose = quality.judge(docs, table, F.lit("x"), quality.Settings(risk=0.1, rules=RULES))
    assert loose.filter("rejected_by = 'symbols'").count() > 500
