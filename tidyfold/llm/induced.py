"""Suffix arrays of many short records by induced sorting, in whole-array steps, and their permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _spread(text: np.ndarray, found: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Append positions to the lists of their characters, keeping their order."""
    if len(found) == 0:
        return
    chars = text[found]
    order = np.argsort(chars, kind="stable")
    chars, found = chars[order], found[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, part in zip(chars[np.append(0, cuts)].tolist(), np.split(found, cuts)):
        lists[c].append(part)


def _induce(text: np.ndarray, smaller: np.ndarray, begin: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, induced from leftmost-smaller ones (`seeds`, in order).

    Buckets are gone through by character; what a bucket induces into itself is
    taken in rounds, one per repetition of the character. Entries of a bucket
    are handled together: each suffix that is larger (smaller) than its
    successor follows from that successor's place.
    """
    seeds_of: list[list[np.ndarray]] = [[] for _ in range(size)]
    _spread(text, seeds, seeds_of)
    larger_of: list[list[np.ndarray]] = [[] for _ in range(size)]
    none = np.zeros(0, seeds.dtype)
    join = lambda parts: np.concatenate(parts) if parts else none
    larger = [none] * size
    for c in range(size):
        now, done = join(larger_of[c]), []
        larger_of[c] = []
        while len(now):
            done.append(now)
            before = now[~begin[now]] - 1
            before = before[~smaller[before]]
            own = text[before] == c
            _spread(text, before[~own], larger_of)
            now = before[own]
        larger[c] = join(done)
        now = join(seeds_of[c])
        before = now[~begin[now]] - 1
        _spread(text, before[~smaller[before]], larger_of)
    smaller_of: list[list[np.ndarray]] = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        now, done = join(smaller_of[c]) if c else join(seeds_of[0])[::-1], []
        smaller_of[c] = []
        while len(now):
            done.append(now)
            before = now[~begin[now]] - 1
            before = before[smaller[before]]
            own = text[before] == c
            _spread(text, before[~own], smaller_of)
            now = before[own]
        right = larger[c][::-1]
        out += [*done, right] if not done else [join(done), right]
        before = right[~begin[right]] - 1
        _spread(text, before[smaller[before]], smaller_of)
    return join(out)[::-1]


def _rank_suffixes(names: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of the reduced records (`following` is the next symbol's place, or -1): doubling the compared length until no rank changes."""
    rank, step = names + 1, following
    while True:
        after = np.where(step >= 0, rank[step], 0)
        pair = rank * (len(rank) + 2) + after
        finer = np.unique(pair, return_inverse=True)[1] + 1
        step = np.where(step >= 0, step[step], -1)
        if finer.max() == rank.max() or (step < 0).all():
            return finer
        rank = finer


def suffix_array(text: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Positions of `text` in suffix order. Each record begins at `begin` and ends with the symbol 0, its end.

    Suffixes that are equal up to their records' ends are in any order.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # Types: a position is smaller if its next different character is larger; a record's end is.
    end = text == 0
    kind = np.int32 if n < 2**31 else np.int64
    differs = np.append(text[1:] != text[:-1], True) | end
    at = np.where(differs, np.arange(n, dtype=kind), kind(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = end | (text[np.minimum(at, n - 2) + 1 if n > 1 else at] > text[at]) & ~end[at]
    del at, differs
    left = np.append(False, ~smaller[:-1]) & smaller & ~begin  # leftmost smaller
    places = np.flatnonzero(left).astype(kind)
    rough = places[np.argsort(text[places], kind="stable")]
    order = _induce(text, smaller, begin, rough, size)
    order = order[left[order]]
    # Name the leftmost-smaller substrings (each reaches to the next one's first character) by content.
    index = np.full(n + 1, -1, kind)
    index[places] = np.arange(len(places), dtype=kind)
    following = np.append(np.arange(1, len(places)), -1)
    following[end[places]] = -1
    stop = np.where(following >= 0, places[following], places)
    hashes = _substring_hashes(text, places, stop + 1)
    ordered = index[order]
    del index, order
    new = np.append(True, hashes[ordered][1:] != hashes[ordered][:-1])
    names = np.empty(len(places), np.int64)
    names[ordered] = np.cumsum(new) - 1
    rank = names if new.all() else _rank_suffixes(names, following)
    return _induce(text, smaller, begin, places[np.argsort(rank, kind="stable")], size)


def _substring_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    from tidyfold.llm.common import mix

    total = np.zeros(len(start), np.uint64)
    length = stop - start
    last = len(text) - 1
    for k in range(int(length.max()) if len(length) else 0):
        some = np.flatnonzero(length > k)
        total[some] = mix(total[some] ^ (text[np.minimum(start[some] + k, last)].astype(np.uint64) + np.uint64(1))) + np.uint64(k)
    return total


def permuted_prefixes(text: np.ndarray, starts: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position the length, up to `most`, that its suffix shares with the one before it in `order`.

    In text order the length falls by one at most from a position to the next;
    all records (which begin at `starts`) step along together.
    """
    n = len(text)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int16)
    lengths = np.diff(np.append(starts, n))
    lane = np.argsort(-lengths, kind="stable")
    at, lengths = starts[lane].copy(), lengths[lane]
    shared = np.zeros(len(lane), np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        at_, shared = at[:live] + step, np.maximum(shared[:live] - 1, 0)
        other = before[at_]
        shared[other < 0] = 0
        grow = np.flatnonzero(other >= 0)
        while len(grow):
            a, b = at_[grow] + shared[grow], other[grow] + shared[grow]
            same = (shared[grow] < most) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]) & (text[np.minimum(a, n - 1)] != 0)
            grow = grow[same]
            shared[grow] += 1
        out[at_] = shared
    return out
