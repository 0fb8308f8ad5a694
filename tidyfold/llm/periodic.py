"""Runs of periodic words by a suffix automaton with link-cut access.

Words of one text are numbered and read left to right. In the suffix automaton's
link tree, the path of the prefix that ends at a word carries every string that
ends there; each state knows where its strings ended last. Appending the word
recolours its path from the leaf to the root, segment by segment of equal last
end (the access of a link-cut tree; the tree is finished first, so its preferred
paths lie on heavy paths, where a recolouring pops segments off a stack). A
segment whose deepest string has length l and ended d words before gives a
square of period d if d <= l, and then d is the smallest period of the l + d
words. Where the next word breaks the period, the square is extended to its run.

Only stretches that can hold a run go through the automaton. In a run of period
q and at least max(24, 3 q) words, each window of 8 words among the first length
- q - 7 occurs again after at most q words, which marks at least max(9, 2 q - 7)
windows in a row; other windows are passed over without losing a run. Runs are
extended and measured on the whole text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import batches, mix, table

#: A run has LEAST words and TIMES periods at least; WINDOW words are looked up to find stretches.
LEAST, TIMES, WINDOW = 24, 3, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Automaton:
    """The suffix automaton of a sequence: link tree, lengths, and each prefix's state."""

    def __init__(self, words: list[int]):
        follow: list[dict[int, int]] = [{}]
        link, length, leaf = [-1], [0], []
        last = 0
        for w in words:
            new = len(link)
            follow.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in follow[p]:
                follow[p][w] = new
                p = link[p]
            if p >= 0:
                q = follow[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(link)
                    follow.append(follow[q].copy()), link.append(link[q]), length.append(length[p] + 1)
                    while p >= 0 and follow[p].get(w) == q:
                        follow[p][w] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            leaf.append(new)
            last = new
        self.link, self.length, self.leaf = link, length, leaf


class Paths:
    """The link tree cut into heavy paths; each path holds its segments of equal last end as a stack, the top of the path last."""

    def __init__(self, link: list[int], length: list[int]):
        n = len(link)
        parent, depth = np.array(link), np.array(length)
        order = np.argsort(depth, kind="stable").tolist()  # parents before children
        size, heavy = [1] * n, [-1] * n
        for v in reversed(order[1:]):
            p = link[v]
            size[p] += size[v]
            if heavy[p] < 0 or size[v] > size[heavy[p]]:
                heavy[p] = v
        self.head = list(range(n))
        for v in order:
            if v and heavy[link[v]] == v:
                self.head[v] = self.head[link[v]]
        self.parent, self.length = parent.tolist(), length
        self.stacks: dict[int, list[tuple[int, int]]] = {}

    def access(self, state: int, now: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from `state` to the root with `now`; (length of the deepest string, last end) of each old segment, deepest first."""
        length, head, parent, stacks = self.length, self.head, self.parent, self.stacks
        while state > 0:
            top = head[state]
            deep = length[state]
            stack = stacks.get(top)
            if stack is None:
                stacks[top] = [(deep, now)]
            else:
                cut = []
                while stack and stack[-1][0] <= deep:
                    cut.append(stack.pop())
                if stack:  # the segment that reaches below the state keeps its lower part
                    yield deep, stack[-1][1]
                yield from reversed(cut)
                stack.append((deep, now))
            state = parent[top]


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, period, words) of each square whose period the next word breaks; `end` is behind its last word."""
    own = Automaton(words)
    paths, n = Paths(own.link, own.length), len(words)
    for i, state in enumerate(own.leaf):
        for deep, before in paths.access(state, i):
            d = i - before
            if d <= deep and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                yield i + 1, d, deep + d


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which no run has its squares."""
    n = len(words)
    if n < LEAST:
        return []
    code = mix(words.astype(np.uint64) + np.uint64(99))
    m = n - WINDOW + 1
    key = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + code[k : k + m]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if np.count_nonzero(same) < LEAST - 2 * WINDOW + 1:
        return []
    gap = np.zeros(m, np.int64)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    for _ in range(2):
        marked = gap > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
        begin, size = edge[::2], edge[1::2] - edge[::2]
        each = np.zeros(m, np.int64)
        each[marked] = np.repeat(size, size)
        gap[(each < LEAST - 2 * WINDOW + 1) | (2 * gap > each + WINDOW - 1)] = 0
    some = np.flatnonzero(gap)
    if len(some) == 0:
        return []
    reach = np.maximum.accumulate(some + gap[some] + WINDOW)
    new = np.flatnonzero(np.append(True, some[1:] > reach[:-1]))
    return [(int(a), int(b)) for a, b in zip(some[new], reach[np.append(new[1:] - 1, len(some) - 1)])]


def leftmost(words: np.ndarray, start: int, period: int) -> int:
    """How far left the period holds from `start` on."""
    width = 64
    while start > 0:
        low = max(0, start - width)
        differ = np.flatnonzero(words[low:start] != words[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, width = low, 2 * width
    return 0


def rightmost(words: np.ndarray, end: int, period: int) -> int:
    """How far right the period holds behind `end`."""
    width = 64
    while end < len(words):
        high = min(len(words), end + width)
        differ = words[end:high] != words[end - period : high - period]
        if differ.any():
            return end + int(differ.argmax())
        end, width = high, 2 * width
    return end


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbered words, by start and period."""
    found = set()
    for a, b in stretches(words):
        for end, period, size in squares(words[a:b].tolist()):
            start, stop = leftmost(words, a + end - size, period), rightmost(words, a + end, period)
            if stop - start >= max(LEAST, TIMES * period):
                found.add((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document under the stated alteration: a tenth of the ids get a periodic end."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


OUT = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(pa.list_(pa.int64())), "collapsed": pa.string()}


def _measure(alter, content: bool):
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 500):
            out = {k: [] for k in OUT}
            for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = WORD.findall(text.as_buffer().to_pybytes()) if text.is_valid else []
                if alter is not None:
                    words = alter(words, i)
                known: dict[bytes, int] = {}
                found = runs(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))) if len(words) >= LEAST else []
                best = (None,) * 4
                if found:
                    s, n, q = top = found[0]
                    for r in found[1:]:  # compared exactly, as products
                        if (r[1] * top[2], -r[0], -r[2]) > (top[1] * r[2], -top[0], -top[2]):
                            top = r
                    s, n, q = top
                    best = (s, n, q, 1000 * n // q)
                    keep = np.zeros(len(words) + 1, np.int32)
                    for s, n, q in found:
                        keep[s + q] += 1
                        keep[s + n] -= 1
                    kept = np.flatnonzero(np.cumsum(keep)[:-1] == 0).tolist()
                    words = [words[k] for k in kept]
                told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                collapsed = b" ".join(words)
                row = (i, len(found), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), found if content else None, collapsed.decode() if content else None)
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, OUT[k]) for k, v in out.items()], names=list(OUT))

    return work


def periodic_runs(docs: DataFrame, alter=None, content: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed) per row of (doc_id, text).

    `runs` are [start, length, period] of all runs, `collapsed` is the text
    without what repeats in a run after its first period; both are null unless
    `content`. start to exponent_milli describe the run of greatest length /
    period (ties: smallest start, then period) and are null without a run.
    `alter(words, doc_id)` may replace a document's words first. Null texts have
    no words; words differ by case. Other columns are left out; repeated rows
    and null ids each give their row; empty tables give empty results. A worker
    holds one document's words, and about 600 bytes for each word of one
    stretch.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<array<long>>, collapsed string"
    return rows.mapInArrow(_measure(alter, content), schema)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs(table(spark, folder, "documents"), planted, content=False).drop("runs", "collapsed")
