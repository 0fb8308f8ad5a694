import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidyfold.llm import scoring
from tidyfold.llm.eliasfano import EliasFano, Trie, coded, decoded

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    """Scores by definition with dictionaries; rows are (doc_id, text, held_out)."""
    split = [(i, [*WORD.findall((t or "").encode().lower()), b"\n"], h) for i, t, h in rows]
    one, two, three, contexts, pairs = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, words, held in split:
        if not held:
            before = [b"\r", *words]
            one.update(words)
            contexts.update(before[:-1])
            two.update(zip(before, words))
            three.update(zip(before, words, words[1:]))
    for (u, v, _), n in three.items():
        pairs[u, v] += n
    total, distinct = sum(one.values()), len(one)
    out = []
    for i, words, held in split:
        base = score = 0.0
        for k, w in enumerate(words):
            v = words[k - 1] if k else b"\r"
            p = (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            for c, n in ((contexts[v], two[v, w]), (k and pairs[words[k - 2] if k > 1 else b"\r", v], k and three[words[k - 2] if k > 1 else b"\r", v, w])):
                weight = scoring.WEIGHT * c**scoring.POWER
                p = (n + weight * p) / (c + weight) if c else p
            score += math.log10(p)
        out.append((i, held, len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = sorted(map(tuple, scoring.score_documents(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
    want = sorted(((i, n, k, t, b, s) for i, _, n, k, t, b, s in brute(rows)), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)
        assert abs(a[5] - b[5]) <= 1.3e-4 * a[1] + 1e-9


def test_elias_fano_reads_and_finds():
    rng = np.random.default_rng(1)
    for universe, n in ((1, 1), (10, 50), (1 << 40, 1000), (5000, 300)):
        values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        ef = EliasFano.build(values, universe)
        assert (ef.get(np.arange(n)) == values).all()
        keys = rng.integers(0, universe, 200).astype(np.uint64)
        place, found = ef.successor(np.concatenate([keys, values]))
        assert (found == np.isin(np.concatenate([keys, values]), values)).all()
        assert (values[place[found]] == np.concatenate([keys, values])[found]).all()


def test_trie_is_read_through_its_pointers():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(1 << 60, 1 << 62, 40).astype(np.uint64)) * np.uint64(4)
    pairs = np.unique(np.stack([rng.integers(0, 40, 300), rng.choice([0, 5, 9, (1 << 40) - 1], 300)], 1), axis=0)
    triples = np.unique(np.stack([rng.integers(0, len(pairs), 500), rng.choice([0, 1, 7, (1 << 40) - 1], 500)], 1), axis=0)
    two, rest, three = (rng.random(n) for n in (len(pairs), len(pairs), len(triples)))
    trie = Trie(words, pairs[:, 0], pairs[:, 1].astype(np.uint64), coded(two), coded(rest), triples[:, 0], triples[:, 1].astype(np.uint64), coded(three))
    want2, want3 = {tuple(p): k for k, p in enumerate(pairs.tolist())}, {tuple(p): x for p, x in zip(triples.tolist(), three)}
    asked = [(w, k) for w in range(40) for k in (0, 4, 5, 9, 10, (1 << 40) - 1)]
    place, found, code, left = trie.pairs(words[[w for w, _ in asked]], np.array([k for _, k in asked], np.uint64))
    for q, p, f, c, r in zip(asked, place, found, decoded(code), decoded(left)):
        assert f == (q in want2)
        assert c == pytest.approx(two[want2[q]] if f else 0, rel=3e-4)
        assert r == pytest.approx(rest[want2[q]] if f else 1, rel=3e-4)
        assert not f or p == want2[q]
    asked = [(p, k) for p in range(len(pairs)) for k in (0, 1, 2, 7, (1 << 40) - 1)]
    got = decoded(trie.triples(np.array([p for p, _ in asked]), np.array([k for _, k in asked], np.uint64)))
    assert got == pytest.approx([want3.get(q, 0) for q in asked], rel=3e-4)
    assert trie.level2.size(np.arange(40)).tolist() == np.bincount(pairs[:, 0], minlength=40).tolist()
    assert trie.pairs(words[:1] + np.uint64(2), np.zeros(1, np.uint64))[1].tolist() == [False]


def test_runs_are_the_same_however_many_words():
    one, two, three = np.random.default_rng(3).integers(0, 4, (3, 200))
    (few, a), (many, b) = (scoring.distinct_runs(one, two, three, most) for most in (3, 1 << 22))
    assert (few == many).all() and (a == b).all() and (few[:, a] == np.stack([one, two, three])).all()


def test_packed_words_come_back():
    keys = np.random.default_rng(4).integers(1, 1 << 63, 50).astype(np.uint64)
    listed = scoring.Frequent(np.append(keys[:20], scoring.END), np.arange(21))
    asked = np.append(keys, [scoring.END, scoring.BEGIN, scoring.AFTER])
    for width in (8, 5):
        got = listed.unpack(listed.pack(listed.codes(asked), asked, width), width)
        assert (got == asked >> np.uint64(64 - 8 * width) << np.uint64(64 - 8 * width)).all()
    assert len(listed.unpack(listed.pack(listed.codes(asked[:0]), asked[:0], 5), 5)) == 0


def test_a_block_lays_out_its_runs():
    texts = pa.array(["a b a b", None, "c"])
    few = scoring.Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    usual = scoring.Block(texts, np.ones(3, np.int8), 3, 1, few)
    rows = usual.known[np.stack([usual.one, usual.two, usual.three])][:, usual.place].T.tolist()
    assert len(rows) == 8 and rows[0][0] == int(scoring.BEGIN) and rows[4][1:] == [int(scoring.END), int(scoring.AFTER)]
    assert usual.times.sum() == 8


def test_scores_follow_the_definition(spark):
    docs = [(i, t, zlib.crc32(str(i).encode()) % 5 == 1) for i, t in enumerate(["a b a b c", "A B\tb", "", None, "  ", "x" * 5000, "a b a b c", "b " * 3000, "né né ñ"] * 3)]
    check(spark, docs)


def test_frequent_words_are_dealt_by_their_next(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD", 50)
    monkeypatch.setattr(scoring, "FREQUENT", 20)
    docs = [(i, " ".join(f"w{(i * k) % 17} the" for k in range(30)), i % 5 == 1) for i in range(20)]
    check(spark, docs)


def test_no_training_rows_and_no_rows(spark):
    check(spark, [(1, "a b", True), (None, "a", True)])
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert scoring.score_documents(empty).count() == 0


def test_scores_beat_the_base_on_held_out_copies(spark):
    docs = [(i, f"one two three four five six {i % 3}", i % 4 == 0) for i in range(40)]
    rows = scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string, held_out boolean")).collect()
    assert all(r.score > r.base_score for r in rows)


def test_one_formula_at_every_size(spark):
    texts = ["a b c a b d", "a b c", "b c a", ""] * 10
    check(spark, [(i, t, i % 5 == 1) for i, t in enumerate(texts)])
    check(spark, [(i, t, i % 5 == 1) for i, t in enumerate(texts * 20)])


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b", False, 1), (None, "a b", False, 2), (7, None, False, 3), (7, "b a", None, 4)], "doc_id long, text string, held_out boolean, row_id int").withColumn("shard", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in scoring.score_documents(docs).collect())
    assert got == [(0, 3, 3), (0, 3, 3), (7, 1, 1), (7, 3, 3)]

