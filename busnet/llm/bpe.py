"""Byte-level BPE in two tiers, and back.

Tier one: a minimal perfect hash (hash and displace) over the vocabulary finds pre-tokens that are
tokens as they stand; the slot's bytes are compared, so no other pre-token passes.  Tier two: the
rest is merged with a heap of candidate pairs over a doubly linked list of bytes, lowest rank first,
leftmost on ties.  The tables are as large as the vocabulary file, whatever the corpus, and go to
the tasks as one Spark broadcast.

Rows: a null text is an empty one (no ids, empty bytes).  Repeated rows are encoded each.  Texts
beyond `arrow.BLOCK` bytes are streamed, so only their hashes stay in memory.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from busnet.llm import arrow, hashing

#: Pre-tokens handled together.
_GROUP = 1 << 18
#: Pre-tokens that a task remembers in each of two generations, and the longest of them.
_REMEMBERED = 1 << 18
_REMEMBERED_LENGTH = 64


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: every key gets its own slot of len(keys)."""

    def __init__(self, keys: np.ndarray, load: int = 2):
        self.n = len(keys)
        self.buckets = max(1, self.n // load)
        self.shift = np.zeros(self.buckets, np.int64)
        of = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(self.n, bool)
        # crowded buckets choose first; those of one size try the same shift together, the earlier one wins a slot
        for size in range(int(sizes.max(initial=0)), 1, -1):
            waiting = np.flatnonzero(sizes == size)
            members = keys[order[bounds[waiting][:, None] + np.arange(size)]]
            d = 0
            while len(waiting):
                d += 1
                slots = (hashing.mix(members + np.uint64(d)) % np.uint64(self.n)).astype(np.int64)
                inner = np.sort(slots, axis=1)
                free = np.flatnonzero(~taken[slots].any(1) & (inner[:, 1:] != inner[:, :-1]).all(1))
                wanted, first = np.unique(slots[free].ravel(), return_index=True)
                owner = first[np.searchsorted(wanted, slots[free])] // size
                won = free[(owner == np.arange(len(free))[:, None]).all(1)]
                taken[slots[won]] = True
                self.shift[waiting[won]] = d
                left = np.ones(len(waiting), bool)
                left[won] = False
                waiting, members = waiting[left], members[left]
        # a bucket of one key names its slot itself
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - np.flatnonzero(~taken)[: len(single)]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        thrown = hashing.mix(keys + np.maximum(d, 0).astype(np.uint64)) % np.uint64(self.n)
        return np.where(d < 0, -1 - d, thrown.astype(np.int64))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, rank_of: Callable[[bytes], int | None]) -> list[int]:
    """Ids of one pre-token: pairs of neighbours are joined by rank, then position.

    A heap entry holds rank and start; it is stale once the pair at that start has another rank.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n))  # start of the part before the one that starts here
    pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    heap = [r << 32 | i for i, r in enumerate(pair) if r is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        start = entry & 0xFFFFFFFF
        if pair[start] != entry >> 32:
            continue
        middle = end[start]
        stop = end[start] = end[middle]
        pair[middle] = None
        if stop < n:
            before[stop] = start
            rank = pair[start] = rank_of(piece[start : end[stop]])
            if rank is not None:
                heapq.heappush(heap, rank << 32 | start)
        else:
            pair[start] = None
        left = before[start]
        if left >= 0:
            rank = pair[left] = rank_of(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, rank << 32 | left)
    out, at = [], 0
    while at < n:
        out.append(rank_of(piece[at : end[at]]))
        at = end[at]
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start .. start + length of each entry, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Encoder and decoder of one vocabulary (every single byte must be a token)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        keys = self._keys(*arrow.utf8(pa.array(tokens, pa.large_binary())))
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two tokens share a 64-bit hash")
        self.table = PerfectHash(keys)
        self.token_at: list[bytes] = [b""] * len(tokens)
        for slot, token in zip(self.table.slots(keys).tolist(), tokens):
            self.token_at[slot] = token
        self.id_at = [ranks[t] for t in self.token_at]
        by_id = sorted(tokens, key=ranks.__getitem__)
        self.length_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.start_of = np.zeros_like(self.length_of)
        ids = np.array([ranks[t] for t in by_id])
        self.length_of[ids] = [len(t) for t in by_id]
        self.start_of[ids] = np.cumsum(self.length_of[ids]) - self.length_of[ids]
        # what the last pre-tokens came to, in two generations
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.bytes_of = np.frombuffer(b"".join(by_id), np.uint8)

    @staticmethod
    def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return hashing.pieces(data, offsets[:-1], offsets[1:])

    def resolve(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens: those that are tokens by the perfect hash, the others merged."""
        data, offsets = arrow.utf8(pa.array(pieces, pa.large_string()))
        slots = self.table.slots(self._keys(data, offsets)).tolist()
        raw, at, token_at, rank_of = data.tobytes(), offsets.tolist(), self.token_at, self.ranks.get
        out = {}
        for i, piece in enumerate(pieces):
            own = raw[at[i] : at[i + 1]]
            slot = slots[i]
            out[piece] = (self.id_at[slot],) if token_at[slot] == own else tuple(merge(own, rank_of))
        return out

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each piece)."""
        ids = list(map(self.recent.get, pieces))
        missing = [i for i, found in enumerate(ids) if found is None]
        if missing:
            older = self.older
            distinct = {pieces[i] for i in missing}
            known = {p: older[p] for p in distinct if p in older}
            known |= self.resolve(list(distinct - known.keys()))
            for i in missing:
                ids[i] = known[pieces[i]]
            self.recent.update((p, v) for p, v in known.items() if len(p) <= _REMEMBERED_LENGTH)
            if len(self.recent) > _REMEMBERED:
                self.recent, self.older = {}, self.recent
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes_of[_ragged(self.start_of[ids], self.length_of[ids])]

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded bytes) of each text."""
        find = regex.compile(self.pattern)
        if len(texts) == 1 and len(texts[0]) > arrow.BLOCK // 4:
            count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            pieces = (m.group() for m in find.finditer(texts[0]))
            while group := list(islice(pieces, _GROUP)):
                ids, _ = self.encode(group)
                count += len(ids)
                of_ids.update(ids.astype("<u4").tobytes())
                of_bytes.update(self.decode(ids).tobytes())
            yield count, of_ids.hexdigest(), of_bytes.hexdigest()
            return
        pieces, bounds = [], [0]
        for text in texts:
            pieces += find.findall(text)
            bounds.append(len(pieces))
        ids, lengths = self.encode(pieces)
        at = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        decoded = self.decode(ids)
        to = np.concatenate([[0], np.cumsum(self.length_of[ids])])[at]
        words = ids.astype("<u4")
        for i in range(len(texts)):
            yield (
                int(at[i + 1] - at[i]),
                hashlib.sha256(words[at[i] : at[i + 1]].tobytes()).hexdigest(),
                hashlib.sha256(decoded[to[i] : to[i + 1]].tobytes()).hexdigest(),
            )


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256; one row per input row."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def run(batches):
        for batch in batches:
            for block in arrow.blocks(batch):
                texts = ["" if t is None else t for t in block.column("text").to_pylist()]
                rows = list(zip(*codec.value.texts(texts)))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves (array<int>), for writing token files."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def run(batches):
        for batch in batches:
            for block in arrow.blocks(batch):
                find = regex.compile(codec.value.pattern)
                lists = [codec.value.encode(find.findall(t or ""))[0].astype(np.int32) for t in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
