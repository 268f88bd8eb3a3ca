"""Exact removal of byte strings that earlier documents hold, with suffix arrays in shards.

Every window of `length` bytes belongs to the smallest hash among its k-byte strings; neighbouring windows
with one such anchor form a segment.  Equal windows have equal anchors, so an anchor that only one
document holds has no shared window, and the segments of one anchor meet in one shard.  Equal segments
(by anchor and a hash of their bytes, 128 bits together) are one; their smallest doc_id stands for
them, and an anchor with a single segment is settled by it.  The segments of any other anchor are put
into a text whose suffix array, by induced sorting, brings equal windows together: a run of suffixes
with permuted common prefixes of at least `length`.  The smallest doc_id of the run decides for each
window.

Documents are handled in batches of about `batch` bytes (a longer document is a batch).  A batch
speaks once for an anchor and once for a segment, however many of its documents hold it, so a passage in
a third of all documents counts once per batch.  Texts are shuffled once and never gathered.

Rows: a null text has no bytes.  Rows that share a doc_id never remove from each other; a null doc_id
is later than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from busnet.llm import arrow, hashing, induced

_LAST = 2**63 - 1
_ANCHOR = np.uint64(0x5851F42D4C957F2D)
#: Bytes hashed together; their arrays stay in a core's cache.
_BLOCK = 1 << 17
#: Bits of an anchor left out of the table that rules anchors out.
_LOW = np.uint64(42)


@dataclass(frozen=True)
class Settings:
    length: int = 50
    #: Bytes of an anchor.
    anchor: int = 20
    batch: int = 8 << 20
    #: Shards for each batch.
    shards: int = 2
    #: Bytes of segments sorted together; one anchor's segments always are.
    text: int = 1 << 19
    #: Windows of a segment at most; longer ones (texts that repeat themselves) are cut.
    most: int = 512


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _among(wanted: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Finds where values are that occur in wanted; a table of leading bits rules out most of the others."""
    wanted = np.sort(wanted)
    seen = np.zeros(1 << (64 - int(_LOW)), bool)
    seen[wanted >> _LOW] = True

    def positions(values: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(seen[values >> _LOW])
        mine = values[some]
        at = np.searchsorted(wanted, mine)
        at[at == len(wanted)] = 0
        return some[wanted[at] == mine] if len(some) else some

    return positions


def segments(data: np.ndarray, offsets: np.ndarray, rule: Settings, anchors: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(document, start, number of windows, anchor) of the segments of all documents whose anchors are in `anchors` (all if None)."""
    found = []
    last = len(offsets) - 1
    at = 0
    among = None if anchors is None else _among(anchors)
    while at < last:
        end = int(np.searchsorted(offsets, offsets[at] + _BLOCK, side="right")) - 1
        end = min(max(end, at + 1), last)
        base = offsets[at]
        own, bounds = data[base : offsets[end]], offsets[at : end + 1] - base
        if len(own) >= rule.length:
            anchor = _smallest(hashing.kgrams(own, rule.anchor), rule.length - rule.anchor + 1)
            n = len(anchor)
            cut = np.ones(n, bool)
            np.not_equal(anchor[1:], anchor[:-1], out=cut[1:])
            # windows that would leave their document begin where the last full one ends
            limits = np.maximum(bounds[1:] - rule.length + 1, bounds[:-1])
            cut[bounds[:-1][bounds[:-1] < n]] = True
            cut[limits[limits < n]] = True
            starts = np.flatnonzero(cut)
            # a minimum is a small number: mixed, so that buckets are filled evenly
            anchor = hashing.mix(anchor[starts] + _ANCHOR)
            windows = np.diff(np.append(starts, n))
            if among is not None:
                mine = among(anchor)
                starts, windows, anchor = starts[mine], windows[mine], anchor[mine]
            doc = np.searchsorted(bounds, starts, side="right") - 1
            whole = starts < limits[doc]
            starts, windows, doc, anchor = starts[whole], windows[whole], doc[whole], anchor[whole]
            pieces = -(-windows // rule.most)
            inner = _ragged(np.zeros(len(pieces), np.int64), pieces) * rule.most
            starts, doc, anchor = np.repeat(starts, pieces) + inner, np.repeat(doc, pieces), np.repeat(anchor, pieces)
            windows = np.minimum(np.repeat(windows, pieces) - inner, rule.most)
            found.append((doc + at, starts + base, windows, anchor))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


class Batch:
    """The segments of one batch of documents whose anchors are in `anchors` (all if None)."""

    def __init__(self, table: pa.Table, rule: Settings, anchors: np.ndarray | None = None):
        self.rule = rule
        self.data, self.offsets = arrow.utf8(table["text"])
        self.ids = table["doc_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.doc, self.start, self.windows, self.anchor = segments(self.data, self.offsets, rule, anchors)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and whether two documents of the batch hold it."""
        order = np.argsort(self.anchor)
        anchor, ids = self.anchor[order], self.ids[self.doc[order]]
        first = _heads(anchor)
        if not len(first):
            return anchor, np.zeros(0, bool)
        return anchor[first], np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One segment of each kind, by anchor and hash of the bytes, and the number of each segment's kind."""
        self.content = hashing.pieces(self.data, self.start, self.start + self.windows + self.rule.length - 1)
        order = np.lexsort((self.content, self.anchor))
        first = _heads(self.anchor[order], self.content[order])
        number = np.zeros(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        return order[first], number

    def least(self, number: np.ndarray, kinds: int) -> np.ndarray:
        """Smallest doc_id of each kind."""
        out = np.full(kinds, _LAST)
        np.minimum.at(out, number, self.ids[self.doc])
        return out

    def bytes_of(self, some: np.ndarray) -> list[bytes]:
        return [self.data[a : a + n].tobytes() for a, n in zip(self.start[some].tolist(), (self.windows[some] + self.rule.length - 1).tolist())]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def first_holders(content: list[bytes], holder: np.ndarray, rule: Settings) -> list[np.ndarray]:
    """For distinct segments the smallest doc_id that holds each window, by the suffix array of all together."""
    lengths = np.array([len(c) for c in content])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int((lengths + 1).sum()), np.int64)  # 0 ends a segment
    where = _ragged(starts, lengths)
    text[where] = np.frombuffer(b"".join(content), np.uint8).astype(np.int64) + 1
    order = induced.suffix_array(text)
    owner = np.repeat(np.arange(len(content)), lengths + 1)
    windows = lengths - rule.length + 1
    is_window = np.zeros(len(text), bool)
    is_window[_ragged(starts, windows)] = True
    # no suffix stands between two that share a whole window but others that share it too
    order = order[is_window[order]]
    shared = induced.permuted_common_prefixes(text, order, rule.length)
    heads = np.flatnonzero(np.concatenate([[True], shared[order[1:]] < rule.length]))
    least = np.minimum.reduceat(holder[owner[order]], heads)
    at = np.empty(len(text), np.int64)
    at[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return [at[s : s + w] for s, w in zip(starts.tolist(), windows.tolist())]


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(anchor: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Slices of sorted anchors by bucket; buckets are ranges of anchors."""
    of = _bucket(anchor, buckets)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[a]), slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(of)])]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64) if a.dtype == np.uint64 else a


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """All entries of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(values)))


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


_OPEN = -(2**63)  # stands for a doc_id that is still to be decided
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_VERDICT = "batch long, bucket long, sorted boolean, anchors array<long>, counts array<long>, windows array<long>, firsts array<long>"


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))})


def without_repeats(docs: DataFrame, rule: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // rule.batch))
    buckets = batches * rule.shards
    texts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"))
    by_batch = texts.groupBy("batch")

    def rows(batch: pa.Table, anchor: np.ndarray, **lists: list | np.ndarray) -> pa.Table:
        """A row for each bucket with its part of the lists, which follow the sorted anchors."""
        parts = _by_bucket(anchor, buckets)
        kinds = {"several": pa.bool_(), "content": pa.binary()}
        return pa.table({
            "bucket": pa.array([b for b, _ in parts], pa.int64()), "batch": pa.array(batch["batch"].to_pylist()[:1] * len(parts), pa.int64()),
            **{
                n: pa.array([v[s] if isinstance(v, list) else _signed(v[s]) for _, s in parts], pa.list_(kinds.get(n, pa.int64())))
                for n, v in {"anchors": anchor, **lists}.items()
            },
        })

    # 1. anchors that two documents hold
    def speak(table: pa.Table) -> pa.Table:
        anchor, several = Batch(table, rule).anchors()
        return rows(table, anchor, several=several)

    spoken = by_batch.applyInArrow(speak, "bucket long, batch long, anchors array<long>, several array<boolean>")

    def agree(table: pa.Table) -> pa.Table:
        anchor, several, lengths = _flat(table["anchors"]), _flat(table["several"]), _lengths(table["anchors"])
        order = np.argsort(anchor, kind="stable")
        first = _heads(anchor[order])
        if not len(first):
            return _empty("batch long, anchors array<long>")
        count = np.diff(np.append(first, len(order)))
        mine = np.zeros(len(anchor), bool)
        mine[order] = np.repeat((count > 1) | np.logical_or.reduceat(several[order], first), count)
        kept = np.bincount(np.repeat(np.arange(len(lengths)), lengths), mine, len(lengths)).astype(np.int64)
        return pa.table({"batch": table["batch"], "anchors": _lists(anchor[mine], kept)})

    shared = spoken.groupBy("bucket").applyInArrow(agree, "batch long, anchors array<long>")

    # 2. the segments of these, by hash; an anchor with one kind of segment is settled
    def tell(table: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (table.num_rows and anchors.num_rows):
            return _empty("bucket long, batch long, anchors array<long>, hashes array<long>, least array<long>")
        batch = Batch(table, rule, _flat(anchors["anchors"]).view(np.uint64))
        some, number = batch.distinct()
        return rows(table, batch.anchor[some], hashes=batch.content[some], least=batch.least(number, len(some)))

    told = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(
        tell, "bucket long, batch long, anchors array<long>, hashes array<long>, least array<long>"
    )

    def settle(table: pa.Table) -> pa.Table:
        anchor, content, least = (_flat(table[c]) for c in ("anchors", "hashes", "least"))
        order = np.lexsort((content, anchor))
        by_anchor = _heads(anchor[order])
        if not len(by_anchor):
            return _empty(_VERDICT)
        count = np.diff(np.append(by_anchor, len(order)))
        kinds = np.zeros(len(order) + 1, np.int64)
        kinds[_heads(anchor[order], content[order])] = 1
        single = np.add.reduceat(kinds[:-1], by_anchor) == 1
        firsts = np.empty(len(order), np.int64)
        firsts[order] = np.repeat(np.where(single, np.minimum.reduceat(least[order], by_anchor), _OPEN), count)
        lengths = _lengths(table["anchors"])
        none = pa.array([[]] * table.num_rows, pa.list_(pa.int64()))
        return pa.table({
            "batch": table["batch"], "bucket": table["bucket"], "sorted": pa.array([False] * table.num_rows),
            "anchors": table["anchors"], "counts": none, "windows": none, "firsts": _lists(firsts, lengths),
        })

    settled = told.groupBy("bucket").applyInArrow(settle, _VERDICT)

    # 3. the bytes of the others, sorted in shards
    def send(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not (table.num_rows and verdicts.num_rows):
            return _empty("bucket long, batch long, anchors array<long>, content array<binary>, least array<long>")
        verdicts = verdicts.sort_by("bucket")
        batch = Batch(table, rule, _flat(verdicts["anchors"]).view(np.uint64))
        some, number = batch.distinct()
        left = _flat(verdicts["firsts"]) == _OPEN
        least = batch.least(number, len(some))
        return rows(table, batch.anchor[some][left], content=batch.bytes_of(some[left]), least=least[left])

    sent = by_batch.cogroup(settled.groupBy("batch")).applyInArrow(
        send, "bucket long, batch long, anchors array<long>, content array<binary>, least array<long>"
    )

    def sort(table: pa.Table) -> pa.Table:
        """For each batch and segment the smallest doc_id of each window, as runs (windows, doc_id)."""
        content = table["content"].combine_chunks().flatten().to_pylist()
        anchor, least, lengths = _flat(table["anchors"]), _flat(table["least"]), _lengths(table["anchors"])
        holder: dict[bytes, int] = {}
        at: dict[bytes, int] = {}
        for c, a, d in zip(content, anchor.tolist(), least.tolist()):
            holder[c] = min(d, holder.get(c, d))
            at[c] = a
        pending, size, runs = [], 0, {}

        def work() -> None:
            for c, found in zip(pending, first_holders(pending, np.array([holder[c] for c in pending], np.int64), rule)):
                heads = _heads(found)
                runs[c] = (np.diff(np.append(heads, len(found))), found[heads])

        inner = sorted(at, key=at.__getitem__)
        for k, c in enumerate(inner):
            if size > rule.text and at[c] != at[inner[k - 1]]:
                work()
                pending, size = [], 0
            pending.append(c)
            size += len(c)
        if pending:
            work()
        counts = np.array([len(runs[c][0]) for c in content], np.int64)
        of_row = np.bincount(np.repeat(np.arange(len(lengths)), lengths), counts, len(lengths)).astype(np.int64)
        none = np.zeros(0, np.int64)
        windows, firsts = (np.concatenate([runs[c][k] for c in content] or [none]) for k in (0, 1))
        return pa.table({
            "batch": table["batch"], "bucket": table["bucket"], "sorted": pa.array([True] * table.num_rows), "anchors": table["anchors"],
            "counts": _lists(counts, lengths), "windows": _lists(windows, of_row), "firsts": _lists(firsts, of_row),
        })

    ordered = sent.groupBy("bucket").applyInArrow(sort, _VERDICT)

    # 4. back to the documents
    def remove(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _empty(_RESULT)
        verdicts = verdicts.sort_by("bucket")
        told, more = (verdicts.filter(pa.compute.equal(verdicts["sorted"], v)) for v in (False, True))
        batch = Batch(table, rule, _flat(told["anchors"]).view(np.uint64) if told.num_rows else np.zeros(0, np.uint64))
        cover = np.zeros(len(batch.data) + 1, np.int64)
        if len(batch.doc):
            some, number = batch.distinct()
            # the runs of each kind of segment, one after the other: one for a settled one, else those found by sorting
            single = _flat(told["firsts"])
            still = single == _OPEN
            counts, windows, firsts = np.ones(len(some), np.int64), batch.windows[some], single
            if still.any():
                counts[still] = _flat(more["counts"])
                where = np.repeat(still, counts)
                windows, firsts = np.repeat(windows, counts), np.repeat(firsts, counts)
                windows[where], firsts[where] = _flat(more["windows"]), _flat(more["firsts"])
            lead = np.cumsum(counts) - counts
            runs = _ragged(lead[number], counts[number])
            segment = np.repeat(np.arange(len(number)), counts[number])
            length = windows[runs]
            before = np.cumsum(length) - length
            begin = batch.start[segment] + before - before[np.searchsorted(segment, segment)]
            gone = firsts[runs] < batch.ids[batch.doc[segment]]
            np.add.at(cover, begin[gone], 1)
            np.add.at(cover, begin[gone] + length[gone] + rule.length - 1, -1)
        removed = np.cumsum(cover[:-1]) > 0
        inside = np.concatenate([[0], np.cumsum(removed)])
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        edges = batch.offsets[:-1][np.diff(batch.offsets) > 0]
        opens[edges] = removed[edges]
        opened = np.concatenate([[0], np.cumsum(opens)])
        a, b = batch.offsets[:-1], batch.offsets[1:]
        digests = [hashlib.sha256(batch.data[x:y][~removed[x:y]].tobytes()).hexdigest() for x, y in zip(a, b)]
        return pa.table({
            "doc_id": table["doc_id"], "n_bytes": pa.array(b - a), "n_removed": pa.array(inside[b] - inside[a]),
            "n_spans": pa.array(opened[b] - opened[a]), "kept_sha256": pa.array(digests),
        })

    return by_batch.cogroup(settled.unionByName(ordered).groupBy("batch")).applyInArrow(remove, _RESULT)
