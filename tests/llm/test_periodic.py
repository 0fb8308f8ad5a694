import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidyfold.llm import periodic


def brute_runs(w):
    """All runs by definition: maximal stretches of each period that have no smaller one."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(i, text, alter=True):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if alter and h % 10 == 0 and n:
        a, w0 = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [w0[k] if k < a else w0[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return i, len(runs), *head, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        a = rnd.choice([1, 2, 3, 40])
        w = [rnd.randrange(a) for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 3)):
            unit = [rnd.randrange(max(a, 2)) for _ in range(rnd.randint(1, 25))]
            w += (unit * 12)[: rnd.randint(len(unit), 130)] + [rnd.randrange(a) for _ in range(rnd.randint(0, 9))]
        yield w


def test_runs_are_all_runs():
    found = 0
    for w in texts(3, 700):
        want = brute_runs(w)
        assert periodic.runs(np.array(w, np.int64)) == want
        found += len(want)
    assert found > 500


def test_fibonacci_words_and_long_ones():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic.runs(np.array(b)) == brute_runs(b)
    long = np.arange(90_000) % 30_000
    assert periodic.runs(long) == [(0, 90_000, 30_000)]
    assert periodic.runs(long[:-1]) == []


def test_automaton_knows_every_substring():
    w = [0, 1, 0, 0, 1, 0, 1, 1, 0]
    own = periodic.Automaton(w)
    assert sum(own.length[v] - own.length[own.link[v]] for v in range(1, len(own.link))) == len({tuple(w[a:b]) for a in range(9) for b in range(a + 1, 10)})


def test_access_gives_last_ends():
    w = [random.Random(4).randrange(3) for _ in range(200)]
    own = periodic.Automaton(w)
    paths = periodic.Paths(own.link, own.length)
    for i, state in enumerate(own.leaf):
        got = {}
        for deep, before in paths.access(state, i):
            got[before] = max(got.get(before, 0), deep)
        for before, deep in got.items():
            same = 0
            while same <= before and w[before - same] == w[i - same]:
                same += 1
            assert same == deep  # the longest string that ends at both


def test_rows_like_brute_force(spark):
    rows = [(k, " ".join(map(str, w)) if k % 7 else "\t".join(map(str, w)) + "\n") for k, w in enumerate(texts(9, 250))]
    rows += [(None, "a b " * 20), (7, None), (8, ""), (9, " \x0b "), (8, ""), (10**12, "A a " * 30), (11, "x" * 100_000), (12, "é é é  " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("runs", F.lit("clash"))
    got = periodic.periodic_runs(docs, periodic.planted)
    brute = [brute_row("" if i is None else i, t) for i, t in rows]
    want = sorted(((None if b[0] == "" else b[0], *b[1:]) for b in brute), key=repr)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == want
    plain = {(r.doc_id, r.n_runs) for r in periodic.periodic_runs(docs).collect()}
    assert plain == {(i, brute_row(i, t, False)[1]) for i, t in rows}
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter(F.length("text") < 6000)
    got = {r.doc_id: tuple(r) for r in periodic.op13_periodic_runs(spark, folder).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)
