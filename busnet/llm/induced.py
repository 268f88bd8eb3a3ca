"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are smaller (S) or larger (L) than the one after them; an S right after an L starts a
leftmost-smaller substring.  Sorting those induces the order of all L suffixes in one pass from the
left and of all S suffixes in one from the right (Nong, Zhang and Chan, 2009).  The passes go bucket by
bucket with numpy.  The shorter text of substring names has too many characters for that: its suffixes are
sorted by twice as many names in each round, only those that still agree (Larsson and Sadakane, 2007).
"""

from __future__ import annotations

import numpy as np


def _names(text: np.ndarray, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings, equal for equal ones, in their order; stars are in text order."""
    n = len(text)
    number = np.zeros(n, np.int64)
    number[stars] = np.arange(len(stars))
    length = np.diff(np.append(stars, n)) + 1  # up to and with the first character of the next one
    length[-1] = 1
    mine = length[number[order]]
    fresh = np.ones(len(order), bool)
    fresh[1:] = mine[1:] != mine[:-1]
    live = np.flatnonzero(~fresh)
    step = 0
    while len(live):  # neighbours of equal length: compare character by character
        a, b = order[live], order[live - 1]
        other = text[a + step] != text[b + step]
        fresh[live[other]] = True
        live = live[~other & (mine[live] > step + 1)]
        step += 1
    names = np.zeros(len(stars), np.int64)
    names[number[order]] = np.cumsum(fresh) - 1
    return names


def sort_names(text: np.ndarray) -> np.ndarray:
    """Suffix array of numbers that end with their only 0."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)  # where the group of suffixes that agree so far begins
    live, key, step = np.arange(n), text[order], 1
    while True:
        new = np.ones(len(live) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        rank[order[live]] = np.repeat(live[heads[:-1]], np.diff(heads))
        live = live[~(new[:-1] & new[1:])]
        if not len(live):
            return order
        # two that agree on `step` numbers both end later
        own = order[live]
        key = rank[own] * n + rank[own + step]
        by = np.argsort(key, kind="stable")
        order[live], key = own[by], key[by]
        step *= 2


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the last one counts as smaller."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    small = np.ones(n, bool)
    # as at the first change at or after each position
    small[:-1] = np.repeat(text[differs] < text[differs + 1], np.diff(differs, prepend=-1))
    return small


def _induce(text: np.ndarray, size: int, small: np.ndarray, stars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each character its L suffixes and its S suffixes in order."""
    none = np.zeros(0, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(size)]

    def hand_out(positions: np.ndarray) -> None:
        chars = text[positions]
        order = np.argsort(chars, kind="stable")
        bounds = np.flatnonzero(np.diff(chars[order], prepend=-1))
        for k, a in enumerate(bounds):
            b = bounds[k + 1] if k + 1 < len(bounds) else len(order)
            waiting[chars[order[a]]].append(positions[order[a:b]])

    def sweep(chars, own, kind) -> None:
        """own(c): what follows the bucket's induced suffixes; takes in the suffixes of one kind before each."""
        for c in chars:
            rounds, beyond = [], []
            new = np.concatenate(waiting[c]) if waiting[c] else none
            while len(new):
                rounds.append(new)
                before = new[new > 0] - 1
                before = before[kind[before]]
                same = text[before] == c
                beyond.append(before[~same])
                new = before[same]
            done[c] = np.concatenate(rounds) if rounds else none
            waiting[c] = []
            rest = own(c)
            if len(rest):
                before = rest[rest > 0] - 1
                beyond.append(before[kind[before]])
            if beyond and len(before := np.concatenate(beyond)):
                hand_out(before)

    first = text[stars]
    by_char = stars[np.argsort(first, kind="stable")]
    cuts = np.searchsorted(np.sort(first), np.arange(size + 1))
    done: list[np.ndarray] = [none] * size
    sweep(range(size), lambda c: by_char[cuts[c] : cuts[c + 1]], ~small)
    large = done
    done = [none] * size
    waiting[0].append(np.array([len(text) - 1]))  # the end is the only suffix that nothing induces
    sweep(range(size - 1, -1, -1), lambda c: large[c][::-1], small)
    return [(a, b[::-1]) for a, b in zip(large, done)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers (any range up to some thousand values); shorter suffixes are smaller."""
    text = np.concatenate([text.astype(np.int64) + 1, [0]])
    n, size = len(text), int(text.max(initial=0)) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    small = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(stars) > 1:
        is_star = np.zeros(n, bool)
        is_star[stars] = True
        order = np.concatenate([s[is_star[s]] for _, s in _induce(text, size, small, stars)])
        names = _names(text, stars, order)
        count = int(names.max()) + 1
        stars = order if count == len(stars) else stars[sort_names(names)]
    parts = _induce(text, size, small, stars)
    return np.concatenate([p for pair in parts for p in pair])[1:]


_LANE = 4  # characters compared at once


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """At each position the common prefix of its suffix and the one before it in order, up to most; 0 if not in order.

    Four characters (below 65536) are compared at once.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype("<u2"), np.zeros(_LANE, "<u2")])
    lanes = np.ndarray((n + 1,), np.dtype("<u8"), padded, strides=(2,))
    live = np.flatnonzero(before >= 0)
    other = before[live]
    for step in range(0, most, _LANE):
        differs = lanes[np.minimum(live + step, n)] ^ lanes[np.minimum(other + step, n)]
        same = differs == 0
        # equal characters at the beginning of a lane that differs
        lead = sum(((differs & np.uint64((1 << (16 * k)) - 1)) == 0).astype(np.int64) for k in range(1, _LANE))
        shared[live] = step + np.where(same, _LANE, lead)
        live, other = live[same], other[same]
    # what stands beyond the end is no character
    some = before >= 0
    return np.minimum(np.where(some, np.minimum(shared, n - np.maximum(np.arange(n), before)), 0), most)
