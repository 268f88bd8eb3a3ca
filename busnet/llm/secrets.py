"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found by pattern.  A fourth kind, `owned`, takes runs of 20 or more key
characters that mix lower case, upper case and digits, touch no base span, and belong to one owner and few
repositories in the whole corpus: the hash of each candidate value is counted by distinct repositories and owners,
so an example that many owners have copied, or one owner in many places, is told from a credential that looks
alive.  Base spans always stay; for them the same two counts split n_live from n_copied.

Positions: the lengths of matches and of the text between them (`split` by the same pattern) sum up
to code point offsets.  Candidates are written once without the texts, and everything after that
works on those.

Rows: a null text is empty and has no spans.  Repeated rows are scanned each.  A null owner or
repository is a value of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from busnet.session import keep


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the secret value and the least length of that value."""

    name: str
    pattern: str
    group: int
    least: int


#: The base kinds, in the order that breaks ties of position.  For `access` and `hex` the
#: least length stands in the pattern: a shorter match holds no valid one, so the matches are the same.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
OWNED = Kind("owned", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20)


def _matches(text: Column, kind: Kind) -> Column:
    """Array of (gap before the match, its length, its value); empty for a text without a match."""
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    found = F.zip_with(
        F.zip_with(F.split(text, kind.pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"))),
        value,
        lambda a, v: F.struct(a.gap.alias("gap"), a.len.alias("len"), v.alias("value")),
    )
    # split gives one piece more than there are matches; its entry has no value
    return F.when(text.rlike(kind.pattern), F.filter(found, lambda m: m.value.isNotNull())).otherwise(
        F.array().cast("array<struct<gap:int,len:int,value:string>>")
    )


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: row, doc_id, owner, repo and the matches of each kind; no texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(owner, F.lit("")).alias("owner"),
        F.coalesce(repository, F.lit("")).alias("repo"), *[_matches(text, k).alias(k.name) for k in (*BASE, OWNED)],
    )


def _spans(found: DataFrame, number: int, kind: Kind) -> DataFrame:
    running = W.partitionBy("row").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = found.select("row", "owner", "repo", F.posexplode(kind.name).alias("pos", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(running)
    return (
        rows.withColumn("end", end)
        .filter(F.length("m.value") >= kind.least)
        .select(
            "row", "owner", "repo", F.lit(number).alias("no"), F.lit(kind.name).alias("kind"),
            (F.col("end") - F.col("m.len")).alias("start"), "end", F.col("m.value").alias("value"),
        )
    )


def ownership(spans: DataFrame) -> DataFrame:
    """hash -> owners, repositories: distinct counts over the corpus, one level at a time."""
    return (
        spans.select("hash", "owner", "repo").distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))
    )


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, most_owners: int = 1, most_repositories: int = 2) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied; one row per input row.

    `owners` and `repositories` are the greatest counts of a value in the row's spans, 0 without spans.
    """
    found = keep(candidates(docs, owner, repository), "secret-candidates")
    base = None
    for number, kind in enumerate(BASE):
        part = _spans(found, number, kind)
        base = part if base is None else base.unionByName(part)
    rich = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    runs = _spans(found, len(BASE), OWNED).filter(rich)
    hits = keep(base.unionByName(runs).withColumn("hash", F.unhex(F.sha2("value", 256))).drop("value"), "secret-spans")

    # an owned run counts only if no base span of its document reaches into it: the furthest end of the base
    # spans that start before its end tells
    is_base = F.col("no") < len(BASE)
    spot = F.when(is_base, F.col("start")).otherwise(F.col("end") - 1)
    upto = W.partitionBy("row").orderBy("spot").rangeBetween(W.unboundedPreceding, 0)
    free = (
        hits.withColumn("spot", spot)
        .withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(upto))
        .filter(is_base | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    )
    rated = free.join(ownership(hits), "hash").withColumn(
        "live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    ).filter(is_base | F.col("live"))
    each = rated.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "no", "end", "kind"))).alias("all"),
        *[F.count(F.when(F.col("no") == i, 1)).alias(f"n_{k.name}") for i, k in enumerate((*BASE, OWNED))],
        F.count(F.when(is_base & F.col("live"), 1)).alias("n_live"),
        F.count(F.when(is_base & ~F.col("live"), 1)).alias("n_copied"),
        F.max("owners").alias("owners"), F.max("repositories").alias("repositories"),
    )
    only_base = F.filter("all", lambda s: s["no"] < len(BASE))
    counts = [f"n_{k.name}" for k in (*BASE, OWNED)] + ["n_live", "n_copied", "owners", "repositories"]
    return found.select("row", "doc_id").join(each, "row", "left").select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.sha2(F.coalesce(_text(only_base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_text(F.col("all")), F.lit("")).alias("spans"),
    )
