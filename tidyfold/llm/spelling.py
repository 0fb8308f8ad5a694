"""Spelling variants by k-d trees over letter-count vectors.

Two words that differ by one inserted or deleted letter have count vectors at L1
distance 1, by one replaced letter at 2 (order aside). So a word's near words
lie in a box search of its own length with reach 2, and of the next length with
reach 1.

1. Runs of letters are counted, summed per task first; words are those with
   enough letters and occurrences.
2. The words of each length are cut into cells by the upper levels of a k-d
   tree, which are planned on a bounded sample (only the plan: every word goes
   to the cell whose box holds it). A word is also sent as a query to every cell
   of its own and of the next length whose box is within reach.
3. A cell finishes the k-d tree over its words and runs all its queries down it
   together, keeping at each node those within reach of the node's box. Words at
   a leaf are compared by their letters' bits, then letter by letter.
4. Each word's finds are summed; forms are followed to their roots by doubling.
   A form has STEP times the word's occurrences, so chains are logarithmic.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import mix, table, written

LETTERS_LEAST, TIMES_LEAST, STEP, TYPO_EVERY = 6, 5, 5, 199
#: Words of a cell, sampled words that plan the cells (all lengths together), sampled words a cell rests on at least, words of a leaf.
CELL_ROWS, SAMPLE_ROWS, SAMPLE_LEAST, LEAF_ROWS = 32_768, 100_000, 32, 48
#: Distinct words a task holds before it sends their counts on; pairs compared at once.
HELD, PAIRS = 300_000, 1 << 16
LOW, FIRST = ord("a"), 0xC0
DIMENSIONS = 26 + 64
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LETTERS_LEAST)


def altered(run: str, start: int) -> str:
    """The run without one letter if TYPO_EVERY divides its digest, which goes on from the digest `start` of what stands before."""
    h = zlib.crc32(run.encode(), start)
    if h % TYPO_EVERY == 0:
        k = h % len(run)
        return run[:k] + run[k + 1 :]
    return run


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for part in parts:
        for i, text in zip(part.column(0).to_pylist(), part.column(1)):
            if not text.is_valid:
                continue
            start, own = zlib.crc32(f"{'' if i is None else i}:".encode()), {}
            for run in RUN.findall(text.as_buffer().to_pybytes().lower().decode()):  # bytes: only A-Z change
                own[run] = own.get(run, 0) + 1
            for run, n in own.items():
                word = altered(run, start)
                if len(word) >= LETTERS_LEAST:
                    held[word] = held.get(word, 0) + n
            if len(held) >= HELD:
                yield batch()
                held.clear()
    yield batch()


def vectors(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and letter counts of words of one length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32).reshape(len(words), length)
    letters = np.where(codes < FIRST, codes - LOW, codes - FIRST + 26).astype(np.uint8)
    counts = np.zeros((len(words), DIMENSIONS), np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(words)), length), letters.ravel()), 1)
    return letters, counts


_BITS = mix(np.arange(DIMENSIONS * 8, dtype=np.uint64) + np.uint64(0x51ED))


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits whose differing number between two words is at most their L1 distance: the k-th of each letter flips one bit."""
    out = np.zeros(len(counts), np.uint64)
    for k in range(int(counts.max(initial=0))):
        bits = np.uint64(1) << (mix(_BITS[:DIMENSIONS] + np.uint64(k)) % np.uint64(64))
        out ^= np.bitwise_xor.reduce(np.where(counts > k, bits, np.uint64(0)), axis=1)
    return out


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, value) that halves points best: those below the value go left. None if all are alike."""
    best = None
    low, high = points.min(axis=0), points.max(axis=0)
    for d in np.flatnonzero(high > low).tolist():
        column = np.sort(points[:, d])
        value = int(column[len(column) // 2])
        value = value if value > low[d] else value + 1
        left = int(np.searchsorted(column, value))
        uneven = abs(2 * left - len(column))
        if best is None or uneven < best[0]:
            best = (uneven, d, value)
    return best and best[1:]


class Cells:
    """The upper levels of one length's tree: boxes by cell, [low, high] in each dimension."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits: list[tuple[int, int, int, int]] = []  # (dimension, value, left, right); cells are ~index
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.root = self._grow(sample, cells, np.zeros(DIMENSIONS, np.int32), np.full(DIMENSIONS, 1 << 30, np.int32))

    def _grow(self, points, cells, low, high) -> int:
        cut = _cut(points) if cells > 1 and len(points) >= 2 * SAMPLE_LEAST else None
        if cut is None:
            self.boxes.append((low, high))
            return ~(len(self.boxes) - 1)
        d, value = cut
        left, right = high.copy(), low.copy()
        left[d], right[d] = value - 1, value
        k = len(self.splits)
        self.splits.append((d, value, 0, 0))
        below = points[:, d] < value
        self.splits[k] = (d, value, self._grow(points[below], cells // 2, low, left), self._grow(points[~below], cells - cells // 2, right, high))
        return k

    def near(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, places of the points) within `reach` of the cell's box; reach 0: the cell that holds them."""
        todo = [(self.root, np.arange(len(points)), np.zeros((len(points), DIMENSIONS), np.int32) if reach else None)]
        while todo:
            node, some, off = todo.pop()
            if node < 0:
                yield ~node, some
                continue
            d, value, left, right = self.splits[node]
            x = points[some, d]
            for child, far in ((left, x - value + 1), (right, value - x)):
                if off is None:
                    keep = far <= 0
                    todo.append((child, some[keep], None))
                else:
                    own = off.copy()
                    own[:, d] = np.maximum(own[:, d], far)
                    keep = own.sum(axis=1) <= reach
                    todo.append((child, some[keep], own[keep]))


def _groups(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    size = np.array([len(w) for w in words])
    for length in np.unique(size).tolist():
        yield length, np.flatnonzero(size == length)


ROUTED = "length int, cell int, role byte, word string, n long"


def _route(plan: dict[int, Cells], longest: int):
    """Each word to its cell (role 0), and as a query to cells of its own length (1) and of the next (2)."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words, n = part.column(0).to_pylist(), np.asarray(part.column(1))
            for length, some in _groups(words):
                _, counts = vectors([words[k] for k in some], length)
                for role, to, reach in ((0, length, 0), (1, length, 2), (2, length + 1, 1)):
                    if to > longest:
                        continue
                    for cell, places in plan[to].near(counts, reach) if to in plan else [(0, np.arange(len(some)))]:
                        rows = some[places]
                        if len(rows):
                            m = len(rows)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, to, np.int32)), pa.array(np.full(m, cell, np.int32)), pa.array(np.full(m, role, np.int8)), part.column(0).take(pa.array(rows)), pa.array(n[rows])], names=["length", "cell", "role", "word", "n"])

    return work


def box_search(points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of points, places of queries) of each leaf of the points' k-d tree and the queries within reach of its box."""
    if len(points) == 0 or len(queries) == 0:
        return
    used = np.flatnonzero((points.max(axis=0) > 0) | (queries.max(axis=0) > 0))
    points, queries = (x[:, used].astype(np.int16) for x in (points, queries))
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        own, asking = todo.pop()
        inside = points[own]
        low, high = inside.min(axis=0), inside.max(axis=0)
        kept = []
        for at in range(0, len(asking), PAIRS):
            some = asking[at : at + PAIRS]
            x = queries[some]
            off = np.maximum(np.maximum(low - x, x - high), 0).sum(axis=1, dtype=np.int32)
            kept.append(some[off <= reach])
        asking = np.concatenate(kept)
        if len(asking) == 0:
            continue
        cut = _cut(inside) if len(own) > LEAF_ROWS else None
        if cut is None:
            yield own, asking
        else:
            below = inside[:, cut[0]] < cut[1]
            todo += [(own[below], asking), (own[~below], asking)]


def near_pairs(words: list[str], length: int, queries: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, places of queries) one edit apart; queries are as long as the words (a replaced letter) or one letter shorter (an inserted one)."""
    letters, counts = vectors(words, length)
    own, asked = vectors(queries, size)
    reach = 2 if size == length else 1
    bits, wanted = signatures(counts), signatures(asked)
    for some, asking in box_search(counts, asked, reach):
        for at in range(0, len(asking), max(1, PAIRS // len(some))):
            part = asking[at : at + max(1, PAIRS // len(some))]
            q, p = np.nonzero(np.bitwise_count(wanted[part][:, None] ^ bits[some][None, :]) <= reach)
            p, q = some[p], part[q]
            if reach == 2:
                good = (letters[p] != own[q]).sum(axis=1) == 1
            else:  # equal up to the inserted letter, and from behind it on
                differ = own[q] != letters[p][:, :-1]
                first = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
                good = ~((own[q] != letters[p][:, 1:]) & (np.arange(size) >= first[:, None])).any(axis=1)
            yield p[good], q[good]


class _Best:
    """Near words' number, and the one of most occurrences, of each word."""

    def __init__(self, words: list[str]):
        self.words, self.n, self.times, self.form = words, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [""] * len(words)

    def add(self, mine: np.ndarray, others: list[str], times: np.ndarray) -> None:
        np.add.at(self.n, mine, 1)
        for k in np.flatnonzero(times >= self.times[mine]).tolist():
            i, t = mine[k], times[k]
            if t > self.times[i] or t == self.times[i] and others[k] < self.form[i]:
                self.times[i], self.form[i] = t, others[k]

    def rows(self) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
        some = np.flatnonzero(self.n)
        return [self.words[k] for k in some], self.n[some], self.times[some], [self.form[k] for k in some]


FOUND = "word string, near long, form_n long, form string"


def _search(group: pa.Table) -> pa.Table:
    role = np.asarray(group.column("role"))
    length = group.column("length")[0].as_py() if group.num_rows else 0
    words, times = {}, {}
    for r in range(3):
        some = np.flatnonzero(role == r)
        words[r], times[r] = group.column("word").take(pa.array(some)).to_pylist(), np.asarray(group.column("n"))[some]
    out = [[], [], [], []]
    for r, size in ((1, length), (2, length - 1)):
        left, right = _Best(words[0]), _Best(words[r])
        if words[0] and words[r]:
            for p, q in near_pairs(words[0], length, words[r], size):
                right.add(q, [words[0][k] for k in p.tolist()], times[0][p])
                if r == 2:
                    left.add(p, [words[2][k] for k in q.tolist()], times[2][q])
        for best in (left, right):
            for column, x in zip(out, best.rows()):
                column.extend(x)
    return pa.table({k: pa.array(x, t) for k, x, t in zip(("word", "near", "form_n", "form"), out, (pa.string(), pa.int64(), pa.int64(), pa.string()))})


def frequent_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of (doc_id, text) with LETTERS_LEAST letters and TIMES_LEAST occurrences at least."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TIMES_LEAST)


def plan_cells(words: DataFrame) -> tuple[dict[int, Cells], int]:
    """Cells of the lengths that have several, planned on at most about SAMPLE_ROWS words; the longest length."""
    size = F.length("word")
    longest, total = words.agg(F.coalesce(F.max(size), F.lit(0)), F.count(F.lit(1))).first()
    many = {r[0]: r[1] for r in words.groupBy(size).count().filter(F.col("count") > CELL_ROWS).collect()}  # at most total / CELL_ROWS rows
    if not many:
        return {}, longest
    share = min(1.0, SAMPLE_ROWS / total)
    sample = words.filter(size.isin(list(many)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("word").toArrow().column(0).to_pylist()
    return {length: Cells(vectors([sample[k] for k in some], length)[1], math.ceil(many[length] / CELL_ROWS)) for length, some in _groups(sample)}, longest


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of (word, n).

    Words are of the letters a-z and U+00C0 to U+00FF, each once, with positive
    n. `n_near` counts the words one edit away, `form` is the one of them with
    most occurrences (ties: the first in code-point order) if it has STEP times
    the word's, `root` the last of the forms followed from the word. An empty
    table gives an empty result.
    """
    words = written(words.select("word", "n"))
    plan, longest = plan_cells(words)
    routed = words.mapInArrow(_route(plan, longest), ROUTED)
    found = routed.groupBy("length", "cell").applyInArrow(_search, FOUND)
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    good = (-F.col("best.less")) >= STEP * F.col("n")
    forms = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    steps = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 1
    chain = max(1, math.ceil(math.log(most, STEP)))  # forms that can follow each other
    for _ in range(math.ceil(math.log2(chain)) if chain > 1 else 0):
        steps = written(steps)
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = steps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return forms.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the frequent words of (doc_id, text); null texts have no words, other columns are left out, repeated rows count each, a null id is empty in the digest."""
    return variants(frequent_words(docs))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def _crc_table() -> list[int]:
    """The 256 remainders of the reflected polynomial, by its rule."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return out


_HEX = "(strpos('0123456789ABCDEF', h[2 * k - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * k]) - 1"
SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run HAVING length(run) >= {LETTERS_LEAST}),
digests AS (SELECT run, times, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda k: ({_HEX})::UBIGINT), lambda c, b: xor(c >> 8, ({_crc_table()}::UBIGINT[])[(1 + (xor(c, b) & 255))::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS d
    FROM (SELECT run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs)),
counted AS (SELECT CASE WHEN d % {TYPO_EVERY} = 0 THEN substr(run, 1, (d % length(run))::BIGINT) || substr(run, (d % length(run))::BIGINT + 2) ELSE run END AS word, times FROM digests),
vocabulary AS (SELECT word, sum(times)::BIGINT AS n FROM counted GROUP BY word HAVING length(word) >= {LETTERS_LEAST} AND sum(times) >= {TIMES_LEAST}),
cuts AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM vocabulary)),
longer AS (SELECT DISTINCT c.word AS long, v.word AS short FROM cuts c JOIN vocabulary v ON c.rest = v.word),
links AS (SELECT DISTINCT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word UNION ALL SELECT long, short FROM longer UNION ALL SELECT short, long FROM longer),
near AS (SELECT a AS word, count(*) AS n_near, first(struct_pack(form := v.word, form_n := v.n) ORDER BY v.n DESC, v.word) AS best FROM links JOIN vocabulary v ON v.word = b GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.form_n >= {STEP} * n THEN best.form END AS form, CASE WHEN best.form_n >= {STEP} * n THEN best.form_n END AS form_n FROM vocabulary LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain ON chain.word = f.word JOIN forms last ON last.word = chain.root AND last.form IS NULL"""
