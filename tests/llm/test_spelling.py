import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidyfold.llm import spelling


def edits(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if edits(v, w)]
        best = min(near, default=None)
        forms[w] = best[1] if best and -best[0] >= 5 * n else None
        out[w] = (n, len(near), -best[0] if forms[w] else None)
    for w, (n, near, m) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (w, forms[w], root, n, near, m)
    return sorted(out.values())


def vocabulary(seed, n, letters="abé", lengths=(6, 9)):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths))) for _ in range(n)}
    return {w: int(5 ** rnd.uniform(1, 5)) for w in sorted(words)}


def variants(spark, counts):
    return sorted(map(tuple, spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()))


def test_variants_of_dense_words(spark):
    counts = vocabulary(1, 500)
    assert variants(spark, counts) == brute(counts)


def test_many_cells_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_ROWS", 40)
    monkeypatch.setattr(spelling, "SAMPLE_LEAST", 8)
    counts = vocabulary(2, 900, "abcdefÿà", (6, 7)) | {w + w[0]: 7 for w in vocabulary(3, 200, "abcd", (6, 6))}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    plan, longest = spelling.plan_cells(words)
    assert longest == 7 and all(len(p.boxes) > 4 for p in plan.values())
    assert variants(spark, counts) == brute(counts)


def test_box_search_loses_no_neighbour():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 3, (3000, spelling.DIMENSIONS)) * (rng.random(spelling.DIMENSIONS) < 0.15)
    queries = points[rng.integers(0, 3000, 200)] + (rng.random((200, spelling.DIMENSIONS)) < 0.01)
    found = set()
    for some, asking in spelling.box_search(points, queries, 2):
        near = np.abs(points[some][:, None] - queries[asking][None]).sum(axis=2) <= 2
        found |= {(int(some[i]), int(asking[j])) for i, j in zip(*np.nonzero(near))}
    distance = np.abs(points[:, None].astype(np.int8) - queries[None].astype(np.int8)).sum(axis=2)
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(distance <= 2))} and len(found) > 200


def test_signatures_never_exceed_the_distance():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 4, (400, spelling.DIMENSIONS)) * (rng.random((400, spelling.DIMENSIONS)) < 0.1)
    bits = spelling.signatures(counts)
    apart = np.bitwise_count(bits[:200] ^ bits[200:])
    assert (apart <= np.abs(counts[:200] - counts[200:]).sum(axis=1)).all() and apart.max() > 5


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def test_documents_with_nulls_long_texts_and_clashes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rnd = random.Random(8)
    words = list(vocabulary(9, 60, "abcÉé×")) + ["Wordly", "worldly", "WORDLE", "x" * 300, "x" * 301]
    rows = [(k, "-".join(rnd.choice(words) for _ in range(rnd.randint(0, 80)))) for k in range(150)]
    rows += [(None, "worldly " * 5000), (None, "worldly " * 5000), (7, None), (8, ""), (9, "wordly wordlx wordlx " * 6), (9, "É 12 Ωμέγα worldlyΩ " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted(map(tuple, spelling.spelling_variants(docs).collect())) == brute(counted(rows))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.filter("doc_id = 8")).count() == 0
