"""Language-model scoring with sharded Elias-Fano tries of up to three words.

With l(c) = WEIGHT * c ** POWER for every context, and c(v) its occurrences, the
model interpolates p(w | u, v) = (c(u, v, w) + l p(w | v)) / (c(u, v) + l), with
l = l(c(u, v)); p(w | v) = (c(v, w) + l p(w)) / (c(v) + l), with l = l(c(v)); and
the base p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). Words are followed by an end,
and the first has a beginning as its only context. It sums to one for every
context. A trie holds c / (c(context) + l) and l / (c(context) + l).

1. Training words are counted: summed per block of texts, then shuffled.
2. A block asks every shard once, for its distinct runs of three words that begin
   with a word of that shard, with their training occurrences. So however often a
   block repeats a run, it leaves the block once. A shard has about SHARD tokens.
   A word whose runs would fill much of a shard is dealt to several by its next
   word. The words that may need it have N / FREQUENT occurrences at least, so
   their list, the only thing that is broadcast, has at most FREQUENT rows at any
   size of the corpus, 28 bytes each. It decides where runs go and how words are
   sent (as places in the list, which take half of the bytes), and no score.
3. A shard builds its trie from what all blocks send, looks every run up, and
   answers each block with codes in the order of its questions.
4. Each block, laid out again in the same order, puts codes and tokens together
   and sums its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import batches, fold_of, mix, string_bytes, table, words, written
from tidyfold.llm.eliasfano import Trie, coded, decoded

WEIGHT, POWER = 2.0, 0.75
SHARD, FREQUENT, SHARDS_MOST = 1_000_000, 500_000, 100_000
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 100_000
END, BEGIN, AFTER = np.uint64(0x1D), np.uint64(0x2D), np.uint64(0x3D)  # no word hashes to them in practice
NEXT = Trie.BITS // 8  # bytes of the hashes of second and third words
ASKED = "shard int, block long, words binary, pairs binary, seconds binary, runs binary, thirds binary, times binary"
ANSWERED = "block long, shard int, counts binary, two binary, rest binary, three binary"
LAID = "block long, doc_ids array<long>, sizes array<long>, places binary, pairs binary, runs binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def weight(count: np.ndarray) -> np.ndarray:
    """Occurrences' worth of the shorter context, for a context's occurrences."""
    return WEIGHT * np.asarray(count, np.float64) ** POWER


def _press(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b"")


def _expand(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], n, "zstd", asbytes=True) if n else b""


def _planes(x: np.ndarray) -> bytes:
    """Numbers as rows of their lowest, second, ... bytes, compressed."""
    width = x.dtype.itemsize
    return _press(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes())


def _numbers(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_expand(raw), np.uint8).reshape(width, -1).T).view(kind).ravel()


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words and then the end; each token's text."""
    raw, bounds = string_bytes(column)
    _, _, hashes, cuts = words(raw, bounds)
    n = len(column)
    out = np.empty(len(hashes) + n, dtype=np.uint64)
    ends = cuts[1:] + np.arange(n)
    keep = np.ones(len(out), dtype=bool)
    keep[ends] = False
    out[keep], out[ends] = hashes, END
    return out, np.repeat(np.arange(n), np.diff(np.concatenate([[-1], ends])))


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts, BLOCK_ROWS, BLOCK_BYTES):
        found, n = np.unique(tokens(part.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])


class Frequent:
    """Counts of the frequent words, of the end and of what stands around texts, sorted by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.texts = int(counts[hashes == END].sum())
        hashes, counts = np.append(hashes, [BEGIN, AFTER]), np.append(counts, [self.texts, self.texts])
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.ranked = np.argsort(-self.counts, kind="stable")
        self.rank = np.empty(len(order), "<u4")
        self.rank[self.ranked] = np.arange(len(order))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return at, self.hashes[at] == keys

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of words; 0 where they aren't frequent."""
        at, there = self._find(keys)
        return np.where(there, self.counts[at], 0)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """Places in the list, most frequent first; the list's length for other words."""
        at, there = self._find(keys)
        return np.where(there, self.rank[at], len(self.rank)).astype("<u4")

    def pack(self, codes: np.ndarray, keys: np.ndarray, width: int) -> bytes:
        """Words as their codes, and the other words' `width` highest bytes."""
        short, rare = _planes(codes), keys[codes == len(self.rank)]
        return len(short).to_bytes(8, "little") + short + np.ascontiguousarray(rare.view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()

    def unpack(self, raw: bytes, width: int) -> np.ndarray:
        """Hashes of packed words, zeros below their `width` highest bytes."""
        to = 8 + int.from_bytes(raw[:8], "little")
        codes, rare = _numbers(raw[8:to], "<u4"), np.frombuffer(raw[to:], np.uint8).reshape(-1, width)
        out, wide = np.empty(len(codes), np.uint64), np.zeros((len(rare), 8), np.uint8)
        wide[:, 8 - width :] = rare
        listed = codes < len(self.rank)
        out[listed], out[~listed] = self.hashes[self.ranked[codes[listed]]], wide.view(np.uint64).ravel()
        return out & np.uint64(2**64 - (1 << 8 * (8 - width)))


def distinct_runs(one: np.ndarray, two: np.ndarray, three: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct triples of numbers up to `most` in order, as three rows, and each triple's place among them."""
    bits = most.bit_length()
    if 3 * bits <= 64:
        run = (one.astype(np.uint64) << np.uint64(2 * bits)) | (two.astype(np.uint64) << np.uint64(bits)) | three.astype(np.uint64)
        run, place = np.unique(run, return_inverse=True)
        return np.stack([(run >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in (2, 1, 0)]), place
    run, place = np.unique(np.stack([one, two, three], 1), axis=0, return_inverse=True)  # a very long text
    return run.T, place.ravel()


class Block:
    """A block's distinct runs of three, by shard and then by words, and each token's run.

    A token's run begins with the word before it.
    """

    def __init__(self, texts: pa.Array, train: np.ndarray | None, shards: int, share: int, frequent: Frequent):
        token, self.text = tokens(texts)
        known, index = np.unique(token, return_inverse=True)
        n, self.known = len(known), np.append(known, [BEGIN, AFTER])
        first, last = np.ones(len(token), bool), np.ones(len(token), bool)
        first[1:] = last[:-1] = self.text[1:] != self.text[:-1]
        before, after = np.full(len(token), n), np.full(len(token), n + 1)
        before[1:][~first[1:]], after[:-1][~last[:-1]] = index[:-1][~first[1:]], index[1:][~last[:-1]]
        (one, two, three), place = distinct_runs(before, index, after, n + 1)
        times = np.bincount(place, train[self.text], len(one)).astype("<u4") if train is not None else None
        ways = frequent.of(self.known) // share + 1
        salt = mix(self.known[two]) % ways[one].astype(np.uint64)
        with np.errstate(over="ignore"):
            shard = (mix(self.known[one] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.place, self.times = rank[place], times[order] if times is not None else None
        self.shard, self.one, self.two, self.three = shard[order], one[order], two[order], three[order]
        changed = lambda x: np.append(True, x[1:] != x[:-1])
        self.new_word = changed(self.shard) | changed(self.one)
        self.new_pair = self.new_word | changed(self.two)

    def groups(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs a to b: where words and pairs begin, pairs of each word, runs of each pair."""
        word, pair = np.flatnonzero(self.new_word[a:b]), np.flatnonzero(self.new_pair[a:b])
        pairs = np.diff(np.searchsorted(pair, np.append(word, b - a))).astype("<u4")
        return word + a, pair + a, pairs, np.diff(np.append(pair, b - a)).astype("<u4")


def _ask(shards: int, share: int, frequent: Frequent):
    """Each block's questions, one row per shard."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, BLOCK_ROWS, BLOCK_BYTES):
            block = Block(part.column(2), np.asarray(part.column(3).cast(pa.int8())), shards, share, frequent)
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(block.shard) != 0)), len(block.shard))
            rows, codes = [], frequent.codes(block.known)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                word, pair, pairs, runs = block.groups(a, b)
                one, two, three = (frequent.pack(codes[x], block.known[x], width) for x, width in ((block.one[word], 8), (block.two[pair], NEXT), (block.three[a:b], NEXT)))
                rows.append((int(block.shard[a]), part.column(0)[0].as_py(), one, _planes(pairs), two, _planes(runs), three, _planes(block.times[a:b])))
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split(" ")[0] for c in ASKED.split(", ")])

    return work


def _lay(shards: int, share: int, frequent: Frequent):
    """Each block's texts as places among its runs, in the order of its questions."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, BLOCK_ROWS, BLOCK_BYTES):
            block = Block(part.column(2), None, shards, share, frequent)
            _, _, pairs, runs = block.groups(0, len(block.shard))
            row = (part.column(0)[0].as_py(), part.column(1).to_pylist(), np.bincount(block.text, minlength=part.num_rows), _planes(block.place.astype("<u4")), _planes(pairs), _planes(runs))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names=[c.split(" ")[0] for c in LAID.split(", ")])

    return work


def _answer(frequent: Frequent):
    """A shard's trie of all training runs, and the codes of each block's words, pairs and runs."""

    def work(group: pa.Table) -> pa.Table:
        get = lambda k, read: [read(x.as_py()) for x in group.column(k)]
        words_ = get("words", lambda x: frequent.unpack(x, 8))
        seconds, thirds = (get(k, lambda x: frequent.unpack(x, NEXT) >> np.uint64(64 - Trie.BITS)) for k in ("seconds", "thirds"))
        pairs, runs, times = (get(k, lambda x: _numbers(x, "<u4")) for k in ("pairs", "runs", "times"))
        # All blocks' words, pairs and runs as ranks, each level below the ranks of the level above.
        known, word = np.unique(np.concatenate(words_), return_inverse=True)
        shift, low = np.uint64(Trie.BITS), np.uint64((1 << Trie.BITS) - 1)
        level = lambda parent, many, key: np.unique((np.repeat(parent, many).astype(np.uint64) << shift) | key, return_inverse=True)
        two, pair = level(word, np.concatenate(pairs), np.concatenate(seconds))
        three, run = level(pair, np.concatenate(runs), np.concatenate(thirds))
        first, second, above, third = (two >> shift).astype(np.int64), two & low, (three >> shift).astype(np.int64), three & low
        n3 = np.bincount(run, np.concatenate(times), len(three))
        n2 = np.bincount(above, n3, len(two))
        n1 = np.bincount(first, n2, len(known))
        listed = frequent.of(known)
        n1 = np.where(listed > 0, listed, n1)
        # Training runs only are in the trie.
        in1, in2, in3 = (np.flatnonzero(n > 0) for n in (n1, n2, n3))
        total1, total2 = n1[first[in2]], n2[above[in3]]
        trie = Trie(
            known[in1], np.searchsorted(in1, first[in2]), second[in2], coded(n2[in2] / (total1 + weight(total1))), coded(weight(n2[in2]) / (n2[in2] + weight(n2[in2]))),
            np.searchsorted(in2, above[in3]), third[in3], coded(n3[in3] / (total2 + weight(total2))),
        )
        place, found, code2, rest = trie.pairs(known[first], second)
        code3, below = coded(np.zeros(len(three))), found[above]
        code3[below] = trie.triples(place[above[below]], third[below])

        def shares(values: np.ndarray, index: np.ndarray, parts: list[np.ndarray]) -> pa.Array:
            ends = np.cumsum([len(x) for x in parts])
            return pa.array([_planes(values[index[b - len(x) : b]]) for x, b in zip(parts, ends)], pa.binary())

        return pa.table({
            "block": group.column("block"), "shard": group.column("shard"), "counts": shares(n1.astype("<i8"), word, words_),
            "two": shares(code2, pair, seconds), "rest": shares(rest, pair, seconds), "three": shares(code3, run, thirds),
        })

    return work


def _join(total: int, distinct: int, texts: int):
    """A block's scores from its texts' places and the answers, by shard."""

    def work(laid: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")
        count, two, rest, three = (np.concatenate([_numbers(x.as_py(), t) for x in answers.column(k)]) for k, t in (("counts", "<i8"), ("two", np.uint16), ("rest", np.uint16), ("three", np.uint16)))
        place, pairs, runs = (_numbers(laid.column(k)[0].as_py(), "<u4") for k in ("places", "pairs", "runs"))
        if laid.num_rows != 1 or (len(pairs), len(runs), int(runs.sum())) != (len(count), len(two), len(three)):
            raise ValueError("the documents were read in another order the second time")
        size = np.asarray(laid.column("sizes")[0].values)
        pair = np.repeat(np.arange(len(runs)), runs)[place]
        context = np.repeat(count, pairs)[pair].astype(np.float64)
        last = np.cumsum(size) - 1
        first = last - size + 1
        own = np.append(context[1:], 0.0)  # a word is the next token's context
        own[last] = texts
        base = np.log10((own + 0.5) / (total + 0.5 * (distinct + 1)))
        left = np.where(context > 0, weight(context) / np.maximum(context + weight(context), 1e-300), 1.0)
        p = decoded(two[pair]) + left * 10.0**base
        later = np.ones(len(p), bool)
        later[first] = False
        later = np.flatnonzero(later)
        p[later] = decoded(three[place[later - 1]]) + decoded(rest[pair[later - 1]]) * p[later]
        per = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": laid.column("doc_ids")[0].values, "n_tokens": size, "n_known": per((own > 0).astype(np.int64)),
            "base_score": per(base), "score": per(np.log10(p)),
        })

    return work


def score_documents(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of (doc_id, text, held_out).

    The model learns from rows that aren't held out; a null `held_out` counts as
    held out. `docs` is read three times and must come in the same order each
    time, as tables do; if it doesn't, this fails. The trie's values are 16-bit
    codes, so `score` is within 1.3e-4 a token of the definition. Null text is
    the end alone. Repeated rows are scored (and learned) each, null ids too.
    Without any training row every token has the unknown's probability, 1.
    Other columns are left out. Empty tables give empty results.
    """
    train = ~F.coalesce(F.col(held_out), F.lit(True))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("text").cast("string"), train.alias("train"))
    counts = written(docs.filter(train).select(F.col("text").cast("string")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, min(SHARDS_MOST, total // SHARD + 1))
    listed = counts.filter((F.col("n") * FREQUENT >= total) | (F.col("word") == int(END))).toArrow()  # FREQUENT rows and the end at most
    frequent = Frequent(np.asarray(listed.column(0)).astype(np.int64).view(np.uint64), np.asarray(listed.column(1)).astype(np.int64))
    share = max(1, total // (4 * shards))  # tokens of one word that a shard takes
    shared, texts = docs.sparkSession.sparkContext.broadcast(frequent), frequent.texts
    ask = lambda parts: _ask(shards, share, shared.value)(parts)
    lay = lambda parts: _lay(shards, share, shared.value)(parts)
    answer = lambda group: _answer(shared.value)(group)
    answers = rows.mapInArrow(ask, ASKED).groupBy("shard").applyInArrow(answer, ANSWERED)
    scored = rows.mapInArrow(lay, LAID).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join(total, distinct, texts), SCORED)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    held = fold_of(F.col("doc_id"), 5) == 1
    scored = score_documents(table(spark, folder, "documents").withColumn("held_out", held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
