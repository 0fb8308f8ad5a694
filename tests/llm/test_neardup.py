import random

import numpy as np
import pytest

from tests.llm.test_pipeline import shingles
from tidyfold.llm import neardup


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(repr((i, len(s), find(i) if i is not None else None, i is None or find(i) == i)) for i, s in sets)


def family(seed, n, words=80, most=25):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, most)):
            own[rnd.randrange(words)] = word()
        out.append(" ".join(own[: rnd.randint(words - 8, words)]))
    return out


def check(spark, rows):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


@pytest.mark.parametrize("block", [2000, 7])
def test_components_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = family(1, 60) + family(2, 30, 30, 3) + family(3, 25, 12, 2)
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    check(spark, list(zip(ids, texts)))


def test_nulls_short_texts_and_repeats(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    check(spark, [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " x"), (9, "a b"), (9, "a b"), (None, "a b"), (None, None), (10, "É b c d e f"), (11, "é b c d e f")])
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 500, 5000):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        assert (neardup.sketch(a) != 0).all()
    a = rng.integers(1, 2**63, 1000).astype(np.uint64)
    same = np.mean([(neardup.sketch(np.unique(a[:800])) == neardup.sketch(np.unique(np.append(a[:640], rng.integers(1, 2**63, 160).astype(np.uint64))))).mean() for _ in range(20)])
    assert abs(same - 640 / 960) < 0.05


def test_texts_of_one_id_are_in_one_component(spark):
    a, b, c = (family(k, 1)[0] for k in (11, 12, 13))
    rows = [(3, a), (5, a), (5, b), (5, None), (9, b), (9, c), (10, c), (11, None), (None, c), (20, "x y"), (20, "z")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = {3: 3, 5: 3, 9: 3, 10: 3, 11: 11, None: None, 20: 20}
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_extra_columns_with_clashing_names(spark):
    long = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, long, 5, "a", 9), (2, long, 6, "b", 9), (3, "other words", 7, "c", 9)], "doc_id long, text string, id int, whole string, key int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 6, 1, True), (2, 6, 1, False), (3, 1, 3, True)]
