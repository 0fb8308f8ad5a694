import math
import random

import numpy as np

from tidyfold.llm import maxscore


def brute(rows):
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fit:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fit if i != q)[:20]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    return sorted(out)


def counting(monkeypatch):
    """How often queries probed beyond their essential dimensions."""
    seen = []
    partition = maxscore.np.ix_
    monkeypatch.setattr(maxscore.np, "ix_", lambda *a: seen.append(1) or partition(*a))
    return seen


def check(spark, rows):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = maxscore.top_products(table, table.filter("vec_id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 100)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=24)
    rows = [(i, ((i % 3) * centre + rng.normal(size=24) * 10.0 ** rng.integers(-2, 2)).tolist()) for i in range(300)]
    check(spark, rows + [(1000 + i, rows[i][1]) for i in range(40)])


def test_ties_nulls_and_few(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-1, 1)) / 64 for _ in range(5)]) for i in range(120)]
    check(spark, rows + [(200, None), (220, [None, 1.0]), (None, [1.0]), (240, [float("nan")] * 5), (260, [float("inf")] * 5), (280, [])])
    check(spark, [(0, [1.0, 2.0]), (1, [3.0])])
    check(spark, [])


def test_blocks_of_a_shard_use_their_floors(monkeypatch):
    seen, rng = counting(monkeypatch), np.random.default_rng(11)
    for kind, size in ((np.float64, 100), (np.int64, 10**6)):
        vectors = np.floor(rng.normal(size=(900, 30)) * np.linspace(size, 1, 30)).astype(kind)
        ids = np.arange(900)
        found = maxscore.search(ids, vectors, ids[:40], vectors[:40], block=32)
        for i, (near, scores) in enumerate(found):
            want = sorted((-int(s), k) for k, s in enumerate((vectors @ vectors[i]).tolist()) if k != i)[:20]
            assert list(zip((-scores).astype(int).tolist(), near.tolist())) == want
    assert seen


def test_query_blocks_shards_and_repeated_query_rows(spark, monkeypatch):
    for name, n in (("SHARD_ROWS", 50), ("BLOCK_ROWS", 7), ("QUERY_ROWS", 4)):
        monkeypatch.setattr(maxscore, name, n)
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=8) * 4).tolist()) for i in range(260)]
    rows += [rows[20], (40, rows[3][1]), (41, rows[5][1]), (41, rows[6][1])]
    check(spark, rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.integers(-3_000_000, 3_000_000, 4)]) for i in range(60)]
    check(spark, rows)
    check(spark, [(0, [2.0**50, 0.0]), (1, [0.0, -(2.0**50)]), (2, [1 / 64, 2 / 64]), (20, [-3 / 64, 5 / 64])])  # bounds beyond 64 bits, scores within
    for bad in ([(0, [2.0**57]), (1, [1.0])], [(0, [2.0**40]), (1, [2.0**40])]):
        try:
            check(spark, bad)
        except Exception as error:
            assert "doesn't fit a long" in str(error)
        else:
            raise AssertionError("no error")
