"""Repeated runs of lines, found by winnowing.

A document is the sequence of its lines that hold more than white space.  Of every window of `run`
lines the smallest line hash (the rightmost of equals) is selected, so any two equal runs of `run`
lines select the same line: selected lines that occur once in the corpus need no further look.  The
windows behind the others are joined with the first place (doc_id, text, line) that has the same
window; neighbouring matches with the same shift are extended into one run.  Each line of a run that
is not at its first place is deleted.  With `lone`, so is a single repeated line of at least as many
words, whatever stands beside it and if it is the only line of its text; without, single repeated lines
stay.  All is judged on the input.

A window that a third of all documents share has one first place, so it is joined row by row, never
in pairs.

Rows: null texts stay null, empty ones empty; neither has lines.  Equal rows (same doc_id and text)
are one place, so none of them is later than the other.  Rows without a doc_id are each a document of their own,
later than all with one, in the order they are read.  Blank lines are kept and not counted; a document that loses
its last counted line is reported with `emptied`.  Other columns pass through, whatever their names, but for the four
that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from busnet.llm import arrow, hashing
from busnet.session import keep

_NEWLINE = 10
#: Words from which on a single repeated line is deleted too, in the query and the pipeline.
LONE = 13


def _line_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (without the newline) of all lines of one text."""
    breaks = np.flatnonzero(data == _NEWLINE)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])


def _counted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which lines hold more than white space."""
    solid = np.concatenate([[0], np.cumsum(~hashing.SPACE[data])])
    return solid[ends] > solid[starts]


def _whole(data: np.ndarray) -> int:
    """Hash of a whole text, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(data.data, seed=7)).view(np.int64)) if len(data) else 0


def _all_counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the counted lines of all texts, and the first of each text and the end."""
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == _NEWLINE) + 1] = True
    cut[offsets[:-1]] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    # a line ends before the newline that the next one follows, or where its text ends
    newline = np.zeros(len(starts), bool)
    some = ends > starts
    newline[some] = data[ends[some] - 1] == _NEWLINE
    ends = ends - newline
    solid = _counted(data, starts, ends)
    starts, ends = starts[solid], ends[solid]
    return starts, ends, np.searchsorted(starts, offsets)


_WINDOWS = ["doc_id", "row", "th", "first", "key", "pick", "line"]
_LINE = ["doc_id", "row", "th", "first"]


def _place() -> Column:
    """Where a line stands; documents without an id come after the others."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), *_LINE)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words each line (of one byte at least) has."""
    solid = ~hashing.SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    before = np.concatenate([[0], np.cumsum(begin)])
    # a line begins anew, whatever text stands before it
    return before[ends] - before[starts + 1] + solid[starts]


def windows(docs: DataFrame, run: int, lone: int | None = None) -> DataFrame:
    """doc_id, row, th (hash of the text), first (counted line the window starts at), key (of its lines), pick (selected hash), line.

    key and pick are null where too few lines follow; line is the hash of a line of `lone` words or more, else null.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrow.blocks(batch):
                data, offsets = arrow.utf8(block.column("text"))
                all_starts, all_ends, bounds = _all_counted(data, offsets)
                all_lines = hashing.pieces(data, all_starts, all_ends)
                long = np.zeros(len(all_starts), bool) if lone is None else _words(data, all_starts, all_ends) >= lone
                parts = []
                for at, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    line = all_lines[a:b]
                    n = max(0, len(line) - run + 1)
                    rows = n if lone is None else len(line)
                    if not rows:
                        continue
                    key, pick = np.full(n, run, np.uint64), line[:n].copy()
                    for i in range(run):
                        key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + line[i : i + n])
                        np.minimum(pick, line[i : i + n], out=pick)
                    th = _whole(data[offsets[at] : offsets[at + 1]])
                    rest = np.zeros(rows - n, np.uint64)
                    parts.append((
                        np.full(rows, at), np.full(rows, th), np.arange(rows), np.concatenate([key, rest]).view(np.int64),
                        np.concatenate([pick, rest]).view(np.int64), line[:rows].view(np.int64), np.arange(rows) >= n, ~long[a : a + rows],
                    ))
                doc, *columns, short, few = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6 + [np.zeros(0, bool)] * 2
                nulls = [None, None, short, short, few]
                yield pa.RecordBatch.from_arrays(
                    [block.column(n).take(pa.array(doc)) for n in ("doc_id", "row")] + [pa.array(c, pa.int64(), mask=m) for c, m in zip(columns, nulls)],
                    _WINDOWS,
                )

    return docs.select("doc_id", "row", "text").mapInArrow(find, ", ".join(f"{c} long" for c in _WINDOWS))


def repeated(found: DataFrame) -> DataFrame:
    """doc_id, row, th, first and the same of its first place (from_...) of each of the windows that is not there."""
    found, place = found.filter("key IS NOT NULL"), _place()
    # a selected line that has one place has no equal window elsewhere
    picks = found.groupBy("pick").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a < b").select("pick")
    shared = found.join(picks, "pick", "left_semi")
    origin = shared.groupBy("key").agg(F.min(place).alias("from"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return (
        shared.join(origin, "key").filter(place != F.col("from"))
        .select(*_LINE, *[F.col(f"from.{c}").alias(f"from_{c}") for c in _LINE])
    )


def runs(matches: DataFrame, run: int) -> DataFrame:
    """Maximal runs: doc_id, row, th, first and last counted line, from_doc_id and from_first; matches of one shift that touch are one."""
    shift = ["doc_id", "row", "th", "from_doc_id", "from_row", "from_th", "shift"]
    by = W.partitionBy(*shift).orderBy("first")
    marked = matches.withColumn("shift", F.col("first") - F.col("from_first")).withColumn(
        "new", (F.col("first") - F.lag("first").over(by) > run).cast("int")
    )
    island = F.sum(F.coalesce("new", F.lit(1))).over(by.rowsBetween(W.unboundedPreceding, 0))
    return (
        marked.withColumn("island", island).groupBy(*shift, "island")
        .agg(F.min("first").alias("first"), (F.max("first") + run - 1).alias("last"), F.min("from_first").alias("from_first"))
        .select(*_LINE, "last", "from_doc_id", "from_first")
    )


def lone_repeats(found: DataFrame) -> DataFrame:
    """doc_id, row, th, first of each long line of the windows that is not at its first place."""
    found, place = found.filter("line IS NOT NULL"), _place()
    # a line that has one place is not joined
    origin = found.groupBy("line").agg(F.min(place).alias("from"), F.max(place).alias("last")).filter("from < last").select("line", "from")
    return found.join(origin, "line").filter(place != F.col("from")).select(*_LINE)


def _free(docs: DataFrame, name: str) -> str:
    """name, made longer until docs has no such column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def without_repeats(docs: DataFrame, run: int = 2, lone: int | None = None) -> DataFrame:
    """docs with later repeated runs cut out of text, and n_lines, n_removed, n_runs, emptied.

    With `lone`, later repeats of a line of `lone` words or more go even if no line beside them repeats.

    A deleted line goes with its newline (the last one with the newline before it).  Own columns of the
    four names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs", "emptied")
    names, schema = docs.columns, docs.schema
    spans_of, row_of = _free(docs, "spans"), _free(docs, "row")
    # rows without an id are places of their own, told apart by a number
    nameless = keep(docs.filter("doc_id IS NULL").withColumn(row_of, F.monotonically_increasing_id() + 1), "line-nameless")
    docs = docs.filter("doc_id IS NOT NULL").withColumn(row_of, F.lit(0).cast("long")).unionByName(nameless)
    plain = docs.select("doc_id", F.col(row_of).alias("row"), "text")
    found = keep(windows(plain, run, lone).distinct(), "line-windows")
    cuts = runs(repeated(found), run).select(*_LINE, "last")
    if lone is not None:
        cuts = cuts.union(lone_repeats(found).withColumn("last", F.col("first")))
    spans = (
        cuts.groupBy(F.col("doc_id").alias("_of"), F.col("row").alias("_row"))
        .agg(F.collect_list(F.struct("th", "first", "last")).alias(spans_of))
    )
    for own in ("_of", "_row"):
        spans = spans.withColumnRenamed(own, _free(docs, own))
    of, number = spans.columns[:2]
    # with an id the row is 0, without one the row decides
    here = F.coalesce("doc_id", F.lit(0)) == F.coalesce(of, F.lit(0))
    joined = docs.join(spans, here & (F.col(row_of) == F.col(number)), "left").drop(of, number, row_of)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrow.blocks(batch):
                data, offsets = arrow.utf8(block.column("text"))
                spans = block.column(spans_of).to_pylist()
                texts = []
                counts: list[list[int]] = [[], [], []]
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    own = data[a:b]
                    starts, ends = _line_bounds(own)
                    lines = np.flatnonzero(_counted(own, starts, ends))
                    gone = np.zeros(len(lines), bool)
                    mine = []
                    if spans[i] and len(lines):
                        th = _whole(own)
                        mine = sorted((s["first"], s["last"]) for s in spans[i] if s["th"] == th)
                    for first, last in mine:
                        gone[first : last + 1] = True
                    if gone.any():
                        left = np.ones(len(starts), bool)
                        left[lines[gone]] = False
                        raw = own.tobytes()
                        texts.append(b"\n".join(raw[starts[j] : ends[j]] for j in np.flatnonzero(left)).decode())
                    else:
                        texts.append(block.column("text")[i].as_py())
                    counts[0].append(len(lines))
                    counts[1].append(int(gone.sum()))
                    # deleted stretches, however many matches overlap in them
                    counts[2].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
                columns = [block.column(n) if n != "text" else pa.array(texts, block.schema.field("text").type) for n in names]
                emptied = [r > 0 and r == n for n, r in zip(counts[0], counts[1])]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(emptied)], [*names, "n_lines", "n_removed", "n_runs", "emptied"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return joined.mapInArrow(cut, f"{fields}, n_lines long, n_removed long, n_runs long, emptied boolean")
