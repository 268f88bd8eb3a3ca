"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a measure of the text, as a whole number, and a grid of cutoffs from lenient to strict; it rejects a
text whose measure is above the cutoff.  Labelled rows are dealt into two halves by the checksum of doc_id:

* The tuning half only says up to which cutoff a rule is worth testing in a stratum: that with the largest gain,
  bad texts rejected less `price` times the good ones.
* The holdout half certifies.  For a cutoff with n good texts of the stratum, k of them rejected, the p-value
  of "the rule rejects more than the share r of good texts" is the exact binomial tail P(Bin(n, r) <= k).
  The cutoffs of one rule and stratum are tested in order, from lenient to strict, up to the first that fails, which
  needs no correction; over rules and strata the level is divided by their number (Bonferroni).
  Each rule has an equal part of `risk`, so with probability 1 - `level` all rules in force reject together at most
  the share `risk` of the good texts of every stratum.

A text stays if no rule in force in its stratum rejects it.  A stratum with too few labels to certify anything
keeps all its texts.  Counts are a sum over rules x cutoffs x strata, combined before the shuffle; nothing comes to
the driver.

Repeated windows are found inside the row: 64-bit hashes of eight words, made distinct, and only texts where that
loses one are sorted.  Two different windows of a text of a million words share a hash once in 10^8 such texts.

Rows: a null text has no words.  Repeated rows are judged each.  A null stratum is one of its own.  Labels: of several
for one doc_id the worst counts, null ones and those of a null doc_id count nowhere.  Without labels no rule is in
force.  An empty table gives no rows.  Columns of the documents other than those asked for are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from busnet.session import keep

# Words are runs of anything else.
_SPACE = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+"
#: Symbols counted in texts, words of a window, least words and largest share of repeated words in percent.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30


@dataclass(frozen=True)
class Rule:
    """A measure that rejects above its cutoff; cutoffs go from lenient to strict."""

    name: str
    cutoffs: tuple[int, ...]


#: Measures per thousand; `breadth` is characters a word, times ten.
RULES = (
    Rule("symbols", (300, 200, 150, 100, 70, 50, 30, 20, 10, 5)),
    Rule("repeated_lines", (800, 600, 500, 400, 300, 200, 150, 100, 50)),
    Rule("repeated_words", (250, 200, 150, 100, 70, 50, 30)),
    Rule("breadth", (200, 150, 120, 110, 100, 95, 90, 85, 80, 75, 70)),
    Rule("shouting", (900, 700, 500, 400, 300, 200, 150, 100)),
)


@dataclass(frozen=True)
class Settings:
    #: Largest share of good texts that all rules together may reject in a stratum.
    risk: float = 0.05
    #: Probability that any cutoff in force breaks that.
    level: float = 0.05
    #: Good texts rejected that outweigh a bad one, when cutoffs are tuned.
    price: int = 5
    rules: tuple[Rule, ...] = RULES


def _per_mille(part: Column, of: Column) -> Column:
    return F.when(of > 0, F.floor(part * 1000 / of)).otherwise(0).cast("long")


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the measure of each rule."""
    text = F.coalesce("text", F.lit(""))
    shown = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, _SPACE, "")) > 0)
    words = docs.select(
        *columns,
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("upper"),
        shown.alias("lines"),
        F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("words"),
    )
    # the hash of a window runs over those of its words
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.element_at("words", i + j) for j in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = words.select(
        *columns, "word_chars", "n_symbols", "upper", F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    # (hash, place) in order, only where a window stands twice
    placed = hashed.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    # a window's neighbours in that order tell whether it is repeated
    again = F.filter("sorted", lambda e, k: (F.get("sorted", k - 1)["h"] == e["h"]) | (F.get("sorted", k + 1)["h"] == e["h"]))
    places = placed.withColumn("places", F.array_sort(F.transform(again, lambda e: e["i"])))
    covered = F.aggregate(
        F.coalesce("places", F.array().cast("array<int>")), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"],
    )
    counts = places.select(*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "upper")
    return counts.select(
        *columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _per_mille(F.col("n_symbols"), F.col("word_chars")).alias("symbols"),
        _per_mille(F.col("n_dup_lines"), F.col("n_lines")).alias("repeated_lines"),
        _per_mille(F.col("n_repeat_words"), F.col("n_words")).alias("repeated_words"),
        F.when(F.col("n_words") > 0, F.floor(F.col("word_chars") * 10 / F.col("n_words"))).otherwise(0).cast("long").alias("breadth"),
        _per_mille(F.col("upper"), F.col("word_chars")).alias("shouting"),
    )


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Bin(n, share) <= k), summed in logarithms; from the mean on, where it exceeds a half, it is given as 1."""
    odds = F.log(F.lit(share / (1 - share)))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + odds
        most, least = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (most + F.log1p(F.exp(least - most))).alias("sum"))

    none = n * F.log(F.lit(1 - share))
    start = F.struct(none.alias("term"), none.alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, add, lambda s: F.exp(s["sum"]))
    return F.when(k >= n * share, F.lit(1.0)).when(k == 0, F.exp(none)).otherwise(tail)


def _stratum(of: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), of.cast("string")), F.lit(""))


def counted(labelled: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Labelled measures (doc_id, stratum, quality, ...) -> counts per stratum, rule and cutoff (its place in the grid)."""
    met = F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(len(rule.cutoffs)).alias("grid"),
            # cutoffs that let the row pass; the next and all after it reject
            sum((F.when(F.col(rule.name) <= c, 1).otherwise(0) for c in rule.cutoffs), F.lit(0)).alias("passed"),
        )
        for i, rule in enumerate(rules)
    ])
    rows = labelled.select("stratum", (F.crc32(F.col("doc_id").cast("string")) % 2 == 1).alias("held"), (F.col("quality") > 0).alias("good"), F.explode(met).alias("m"))
    groups = rows.groupBy("stratum", "held", "good", "m.rule", "m.grid", "m.passed").agg(F.count("*").alias("n"))
    cells = groups.withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    hit = F.col("passed") <= F.col("cutoff")
    count = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
    return cells.groupBy("stratum", "rule", "cutoff").agg(
        count(~F.col("held") & ~F.col("good") & hit).alias("bad_hit"), count(~F.col("held") & F.col("good") & hit).alias("good_hit"),
        count(F.col("held") & F.col("good")).alias("n"), count(F.col("held") & F.col("good") & hit).alias("k"),
    )


def thresholds(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The certified cutoffs: stratum, rule, cutoff (places), n, k and the p-value."""
    gain = F.col("bad_hit") - settings.price * F.col("good_hit")
    by_rule = W.partitionBy("stratum", "rule")
    # up to the first cutoff with the largest gain
    proposed = keep(
        counted(labelled, settings.rules)
        .withColumn("gain", gain)
        .withColumn("most", F.max("gain").over(by_rule))
        .withColumn("last", F.min(F.when(F.col("gain") == F.col("most"), F.col("cutoff"))).over(by_rule))
        .filter("most > 0 AND cutoff <= last"),
        "quality-proposed",
    )
    tests = proposed.select("stratum", "rule").distinct().count()
    p = binomial_tail(F.col("n"), F.col("k"), settings.risk / len(settings.rules))
    tested = proposed.withColumn("p", p).withColumn(
        "worst", F.max("p").over(by_rule.orderBy("cutoff").rowsBetween(W.unboundedPreceding, 0))
    )
    passed = tested.filter(F.col("worst") <= settings.level / max(tests, 1))
    return passed.groupBy("stratum", "rule").agg(F.max(F.struct("cutoff", "n", "k", "p")).alias("c")).select("stratum", "rule", "c.*")


def judge(docs: DataFrame, labels: DataFrame, stratum: Column, settings: Settings = Settings()) -> DataFrame:
    """Documents (doc_id, text) and labels (doc_id, quality) -> counts, measures, base_failed, kept, rejected_by.

    rejected_by lists the rules in force that a text breaks, whether it passed the base or not.
    """
    rules = settings.rules
    seen = keep(measured(docs.select("doc_id", "text", _stratum(stratum).alias("stratum")), "doc_id", "stratum"), "quality-measures")
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # labels grow with the documents: one plan at every size
    found = thresholds(seen.join(known.hint("merge"), "doc_id"), settings)
    per_stratum = found.groupBy(F.col("stratum").alias("of")).agg(
        *[F.max(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"_{rule.name}") for i, rule in enumerate(rules)]
    )
    judged = seen.join(per_stratum, F.col("stratum") == F.col("of"), "left")
    broken = F.array_compact(F.array(*[
        F.when(F.col(rule.name) > F.element_at(F.array(*map(F.lit, rule.cutoffs)), F.col(f"_{rule.name}") + 1), F.lit(rule.name))
        for rule in rules
    ]))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[rule.name for rule in rules],
        failed.alias("base_failed"), F.array_join(broken, ",").alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
