"""Near-duplicate documents by fast similarity sketches, bands and exact verification.

A document is the set of its distinct word shingles.  Each element is thrown into bins in rounds;
a coordinate keeps the smallest (round, hash).  For the first t rounds the bin is drawn by hash, in
the next t rounds every element goes to the round's own bin, so each coordinate is filled after 2t
rounds at most, and mostly after one or two (Dahlgaard, Knudsen and Thorup, 2017).  Coordinates
agree with the probability of the Jaccard similarity, with Chernoff-type concentration.

Documents with equal sets form a class and only its smallest doc_id is compared.  Classes that agree
in a whole band become candidates: each with the smallest and greatest of its buckets, one at a time,
so that a large group of near copies costs a pair or two a member.  Members of one bucket that this
leaves in different components are compared through their rarest shingles, which misses no link.  Links
count only if the full sets confirm them.

Rows: null or empty texts and texts of white space have an empty set and are linked with nothing.
Rows that share a doc_id count as one document (each row is returned).  A row without an id is never
the smallest of its class, and is kept only if it has no copy with an id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from busnet.llm import arrow, hashing
from busnet.operators.graph import connected_components
from busnet.session import keep


@dataclass(frozen=True)
class Similarity:
    """Two documents are linked if 100 * |A and B| >= percent * |A or B|.

    With 32 bands of 4 rows a pair at 0.8 shares no band with a probability of (1 - 0.8^4)^32 = 5e-8.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of distinct 64-bit elements (at least one); size is a power of two up to 128."""
    out = np.full(size, _FULL, np.uint64)
    step = max(1, 1024 // len(elements))
    for first in range(0, 2 * size, step):
        rounds = np.arange(first, min(first + step, 2 * size), dtype=np.uint64)
        drawn = hashing.mix(elements[None, :] ^ hashing.mix(rounds + np.uint64(0x51ED270B))[:, None])
        value = (drawn >> np.uint64(8)) | (rounds << np.uint64(56))[:, None]
        own = (rounds >= size)[:, None]
        bins = np.where(own, (rounds % np.uint64(size))[:, None], drawn & np.uint64(size - 1))
        np.minimum.at(out, bins.astype(np.int64).ravel(), value.ravel())
        if not (out == _FULL).any():
            break
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    parts = coordinates.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for block in arrow.blocks(batch):
        data, offsets = arrow.utf8(block.column("text"))
        hashes, first = hashing.words(data, offsets)
        for i in range(block.num_rows):
            yield np.unique(hashing.shingles(hashes[first[i] : first[i + 1]], shingle))


def _list(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, rule: Similarity) -> DataFrame:
    """doc_id, n (set size), fp_a and fp_b (together 128 bits that identify the set), bands."""

    def run(batches):
        for batch in batches:
            n, a, b, bands = [], [], [], []
            for s in _sets(batch, rule.shingle):
                n.append(len(s))
                a.append(np.sum(hashing.mix(s ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64))
                b.append(np.sum(hashing.mix(s + np.uint64(0x3C6EF372)), dtype=np.uint64))
                bands.append(band_keys(sketch(s, rule.bands * rule.rows), rule.rows) if len(s) else s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)), _list(bands)],
                ["doc_id", "n", "fp_a", "fp_b", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp_a long, fp_b long, bands array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, rule: Similarity) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _list(list(_sets(batch, rule.shingle)))], ["id", "elements"])

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, elements array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame, rule: Similarity) -> DataFrame:
    """Those pairs (a, b) of document ids whose full sets are similar enough, as (src, dst)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = keep(_full_sets(docs, ids, rule), "minhash-sets")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b") - F.col("shared")
    return (
        both.withColumn("shared", shared)
        .filter(100 * F.col("shared") >= rule.percent * total)
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .distinct()
    )


def _fits(n: str, m: str, rule: Similarity) -> Column:
    """Whether the set sizes allow a link."""
    return 100 * F.least(n, m) >= rule.percent * F.greatest(n, m)


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different groups (an id that groups does not list is a group itself)."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("id").alias(end), F.col("component").alias(f"group_{end}")), end, "left")
    return pairs.filter(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b")


def _by_prefix(docs: DataFrame, members: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs (a, b) of members (rep, n, group) in different groups that can be linked.

    Elements are ordered by how many members hold them, rare ones first (Xiao, Wang, Lin and Yu, 2008).
    Linked sets share at least s = percent / (100 + percent) of their sizes together.  So they share one
    of the first elements of both, and what follows the first shared one must still leave room for
    the rest: of the shorter set the first n - 2 s n + 1, of the longer one n - percent * n / 100 + 1.
    A member whose own words fill these places meets nobody.  No link is missed.
    """
    p = rule.percent
    sets = keep(_full_sets(docs, members.select(F.col("rep").alias("doc_id")), rule), "minhash-members")
    rows = sets.select(F.col("id").alias("rep"), F.explode("elements").alias("element"))
    spread = rows.groupBy("element").agg(F.count("*").alias("spread")).filter("spread > 1")
    ranked = rows.join(spread, "element", "left").select(
        "rep", "element", "spread",
        F.row_number().over(W.partitionBy("rep").orderBy(F.coalesce("spread", F.lit(1)), "element")).alias("rank"),
    )
    n = F.col("n")
    prefix = keep(
        ranked.filter("spread IS NOT NULL").join(members, "rep").filter(F.col("rank") <= n - F.ceil(n * p / 100) + 1)
        .select("rep", "n", "group", "element", "rank"),
        "minhash-prefixes",
    )
    shorter = prefix.filter(F.col("rank") <= n - F.ceil(n * 2 * p / (100 + p)) + 1).select(
        F.col("rep").alias("other"), F.col("n").alias("m"), F.col("group").alias("group_m"), "element", F.col("rank").alias("rank_m")
    )
    room = F.least(n - F.col("rank"), F.col("m") - F.col("rank_m")) + 1
    return (
        prefix.join(shorter, "element")
        .filter((F.col("m") <= n) & (F.col("group") != F.col("group_m")) & _fits("n", "m", rule))
        .filter((100 + p) * room >= p * (n + F.col("m")))
        .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    )


def near_duplicates(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept; one row per input row."""
    known = keep(signatures(docs, rule), "minhash-signatures")
    identity = ["fp_a", "fp_b", "n"]
    classes = known.filter("n > 0").groupBy(*identity).agg(F.min("doc_id").alias("rep"))
    reps = known.filter("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = keep(
        reps.select(F.struct(F.col("doc_id").alias("rep"), "n").alias("x"), F.explode("bands").alias("band")), "minhash-bands"
    )
    ends = banded.groupBy("band").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo.rep < hi.rep")
    shared = keep(banded.join(ends, "band"), "minhash-buckets")  # the buckets that hold two classes at least

    # each class with the smallest or greatest of its buckets: first with the one it meets most often ...
    star = keep(
        shared.select("x", F.explode(F.array("lo", "hi")).alias("y"))
        .filter((F.col("x.rep") != F.col("y.rep")) & _fits("x.n", "y.n", rule))
        .select(F.col("x.rep").alias("x"), F.col("y.rep").alias("y")).groupBy("x", "y").agg(F.count("*").alias("times")),
        "minhash-star",
    )
    pair = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    first = keep(
        star.groupBy("x").agg(F.max(F.struct("times", F.negative("y").alias("y"))).alias("most"))
        .select("x", F.negative("most.y").alias("y")).select(*pair).distinct(),
        "minhash-first",
    )
    links = keep(confirmed(docs, first, rule), "minhash-links")
    groups = connected_components(links)

    # ... then with the others, if that has not connected them
    second = keep(_apart(star.select(*pair).distinct().join(first, ["a", "b"], "left_anti"), groups), "minhash-second")
    links = keep(links.unionByName(confirmed(docs, second, rule)), "minhash-links")
    groups = connected_components(links)

    # members of buckets that still hold two groups
    labelled = shared.select("band", F.col("x.rep").alias("rep"), F.col("x.n").alias("n")).join(
        groups.withColumnRenamed("id", "rep"), "rep", "left"
    ).select("band", "rep", "n", F.coalesce("component", "rep").alias("group"))
    split = labelled.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("band")
    members = keep(
        labelled.join(split, "band", "left_semi").select("rep", "n", "group").distinct(),
        "minhash-apart",
    )
    tested = first.unionByName(second)
    rest = keep(_by_prefix(docs, members, rule).join(tested, ["a", "b"], "left_anti"), "minhash-rest")
    groups = connected_components(links.unionByName(confirmed(docs, rest, rule)))

    return (
        known.join(classes, identity, "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "rep", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
