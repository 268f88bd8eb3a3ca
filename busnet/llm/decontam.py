"""Passages of a benchmark in documents: SimHash of item-sized windows, Hamming blocks, exact check.

A window of a document has as many words as the item it is held against; a document that has fewer is
the one window.  Windows and items are
multisets of word shingles; their weighted similarity is sum(min(counts)) / sum(max(counts)).

1. Shingles of a document that can be some item's (a bitmap of fixed size) are joined with the items'
   shingles.  A window that reaches the similarity has at least 2s / (1 + s) of its shingles among
   the item's, and then so has the window that starts at the first of them (or the last window of the
   document); only such windows are fingerprinted, so none is lost.  Of a document of m shingles and an
   item of n > m, s (m + n) / (1 + s) shingles must be shared.
2. Each gets a 64-bit SimHash.  Cut into radius + 1 blocks, two fingerprints within the radius agree in
   one block at least, so an equi-join on (item, block, bits) finds them all.  A window meets the items only that
   share its shingles in step 1: blocks of three bits alone would let most pairs meet.
3. The shingle multisets decide exactly.  Two multisets at 0.8 differ in 9.7 bits on average (deviation
   2.9), so a radius of 20 misses such a pair about once in 5,000; more similar ones hardly ever.

Rows: items of fewer words than a shingle, and null or empty texts, take no part.  Documents and items
are numbered by row, so repeated items are matched each, documents that share a doc_id are searched each
and reported under that id, and rows without an id are searched and reported with a null id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from busnet.llm import arrow, hashing
from busnet.session import keep


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 20
    #: Bits of the bitmap of item shingles.
    bitmap: int = 1 << 22


_BITS = 64
#: Shingles of windows, and pairs of windows and items, that a task holds at a time.
_HELD = 1 << 20
_PAIRS = 256


def simhash(elements: np.ndarray) -> int:
    """64-bit SimHash of a multiset of hashes, as a signed number."""
    bits = np.unpackbits(hashing.mix(elements ^ np.uint64(0x2545F4914F6CDD1D)).view(np.uint8).reshape(len(elements), 8), axis=1)
    return int(np.packbits(2 * bits.sum(0) > len(elements)).view(np.int64)[0])


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / max(1, sum((a | b).values()))


def _items(benchmark: DataFrame, rule: Settings) -> DataFrame:
    """item_id, n (words), fp, elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in arrow.blocks(batch):
                hashes, first = hashing.words(*arrow.utf8(block.column("text")))
                for i, item in enumerate(block.column("item_id").to_pylist()):
                    own = hashes[first[i] : first[i + 1]]
                    if len(own) >= rule.shingle:
                        elements = hashing.shingles(own, rule.shingle)
                        rows.append((item, len(own), simhash(elements), elements.view(np.int64).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["item_id", "n", "fp", "elements"]
            )

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, n long, fp long, elements array<long>")


def _hits(docs: DataFrame, items: DataFrame, rule: Settings) -> DataFrame:
    """doc_id, places: the positions of shingles that an item has, as (item_id, n, at)."""
    slots = items.select(F.explode("elements").alias("s")).select(F.pmod("s", F.lit(rule.bitmap)).alias("s"))
    marked = np.zeros(rule.bitmap, bool)
    marked[slots.distinct().toArrow()["s"].to_numpy()] = True  # at most `bitmap` rows
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(known.value).astype(bool)
        for batch in batches:
            for block in arrow.blocks(batch):
                hashes, first = hashing.words(*arrow.utf8(block.column("text")))
                ids = block.column("doc_id").to_numpy(zero_copy_only=False)
                if len(hashes) < rule.shingle:
                    continue
                elements = hashing.shingles(hashes, rule.shingle)
                at = np.flatnonzero(marked[elements.view(np.int64) % rule.bitmap])
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + rule.shingle <= first[doc + 1]
                at, doc = at[inside], doc[inside]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc], pa.int64()), pa.array(at - first[doc]), pa.array(elements[at].view(np.int64))], ["doc_id", "at", "element"]
                )

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, at long, element long")
    of_items = items.select("item_id", "n", F.explode(F.array_distinct("elements")).alias("element"))
    return (
        found.distinct().join(of_items, "element").groupBy("doc_id")
        .agg(F.collect_list(F.struct("item_id", "n", "at")).alias("places"))
    )


def _starts(at: np.ndarray, size: int, rule: Settings, count: int) -> np.ndarray:
    """Starts of windows of `size` shingles, in a document of `count`, with enough places in them; at is sorted."""
    last = max(0, count - size)
    least = int(np.ceil(rule.similarity * (size + min(size, count)) / (1 + rule.similarity) - 1e-9))
    if len(at) < least:
        return np.zeros(0, np.int64)
    enough = np.searchsorted(at, at + size) - np.arange(len(at)) >= least
    return np.unique(np.minimum(at[enough], last))


def _numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    """df, stored with a number for each row."""
    return keep(df.withColumn(row, F.monotonically_increasing_id()), name)


def matches(docs: DataFrame, benchmark: DataFrame, rule: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, at (word the window starts at), n_words (of the window), similarity of each window that reaches the similarity."""
    rows = _numbered(docs.select("doc_id", "text"), "row", "decontam-rows")
    items = _numbered(benchmark.select("item_id", "text"), "item", "decontam-benchmark")
    found = _matches(rows.select(F.col("row").alias("doc_id"), "text"), items.select(F.col("item").alias("item_id"), "text"), rule)
    return (
        found.withColumnsRenamed({"doc_id": "row", "item_id": "item"}).join(rows.select("row", "doc_id"), "row").join(items.select("item", "item_id"), "item")
        .select("doc_id", "item_id", "at", "n_words", "similarity").distinct()
    )


def _matches(docs: DataFrame, benchmark: DataFrame, rule: Settings) -> DataFrame:
    """As `matches`, of documents and items whose ids are unique and not null."""
    items = keep(_items(benchmark, rule), "decontam-items")
    places = keep(_hits(docs, items, rule), "decontam-places")

    def windows(rows: list[tuple]) -> pa.RecordBatch:
        """Rows whose last two values are arrays of numbers, which no list of Python's ever holds."""
        def lists(k: int) -> pa.Array:
            ends = np.cumsum([0, *(len(r[k]) for r in rows)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)])))

        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)), lists(5), lists(6)],
            ["doc_id", "at", "n", "n_words", "fp", "elements", "asked"],
        )

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrow.blocks(batch):
                rows, held = [], 0
                hashes, first = hashing.words(*arrow.utf8(block.column("text")))
                for i, doc in enumerate(block.column("doc_id").to_pylist()):
                    own = hashes[first[i] : first[i + 1]]
                    if len(own) < rule.shingle:
                        continue
                    elements = hashing.shingles(own, rule.shingle)
                    by_item: dict[tuple[int, int], list[int]] = {}
                    for p in block.column("places")[i].as_py():
                        by_item.setdefault((p["item_id"], p["n"]), []).append(p["at"])
                    # a window of n words, and the items that ask for it
                    asked: dict[tuple[int, int], list[int]] = {}
                    for (item, n), at in by_item.items():
                        for s in _starts(np.sort(np.array(at)), n - rule.shingle + 1, rule, len(elements)).tolist():
                            asked.setdefault((n, s), []).append(item)
                    for (n, s), by in sorted(asked.items()):
                        part = elements[s : s + n - rule.shingle + 1]
                        rows.append((doc, s, n, min(n, len(own)), simhash(part), part.view(np.int64), np.array(by, np.int64)))
                        held += len(part) + len(by)
                        if held > _HELD:
                            yield windows(rows)
                            rows, held = [], 0
                yield windows(rows)

    seen = keep(
        # places grow with the documents: one plan at every size
        docs.select("doc_id", "text").join(places.hint("merge"), "doc_id")
        .mapInArrow(fingerprint, "doc_id long, at long, n long, n_words long, fp long, elements array<long>, asked array<long>"),
        "decontam-windows",
    )
    pairs = (
        blocked(seen.select("doc_id", "at", "n", "fp", F.explode("asked").alias("item_id")), rule).withColumnRenamed("fp", "fp_w")
        .join(blocked(items.select("item_id", "fp"), rule), ["item_id", "block", "bits"])
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_w"))) <= rule.radius)
        .select("doc_id", "at", "n", "fp_w", "item_id").distinct()
    )
    both = pairs.join(seen.drop("asked").withColumnRenamed("fp", "fp_w").distinct(), ["doc_id", "at", "n", "fp_w"]).join(
        items.select("item_id", "n", F.col("elements").alias("item")), ["item_id", "n"]
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _PAIRS) for b in batches for i in range(0, b.num_rows, _PAIRS)):
            reached = [similarity(Counter(a), Counter(b)) for a, b in zip(batch.column("elements").to_pylist(), batch.column("item").to_pylist())]
            out = pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "item_id", "at", "n_words")] + [pa.array(reached, pa.float64())],
                ["doc_id", "item_id", "at", "n_words", "similarity"],
            )
            yield out.filter(pa.array([r >= rule.similarity - 1e-12 for r in reached]))

    return both.mapInArrow(decide, "doc_id long, item_id long, at long, n_words long, similarity double").distinct()


def blocked(df: DataFrame, rule: Settings) -> DataFrame:
    """A row for each of radius + 1 blocks of the fingerprint: block and bits."""
    count = rule.radius + 1
    bounds = [i * _BITS // count for i in range(count + 1)]
    parts = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:]))
    ]
    return df.select("*", F.explode(F.array(*parts)).alias("b")).select(*df.columns, "b.block", "b.bits")


def clean(docs: DataFrame, benchmark: DataFrame, rule: Settings = Settings()) -> DataFrame:
    """The documents in which no item is found; each row is judged by its own text, with or without an id."""
    row = "row"
    while row.lower() in (c.lower() for c in docs.columns):
        row += "_"
    rows = _numbered(docs, row, "decontam-rows")
    items = benchmark.select(F.monotonically_increasing_id().alias("item_id"), "text")
    found = _matches(rows.select(F.col(row).alias("doc_id"), "text"), items, rule)
    return rows.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)
