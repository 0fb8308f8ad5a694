import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidyfold.llm import language, toxicity


def test_word_probability_sums_over_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"ba", b" ab", b"cabca"]
    p = np.zeros((len(pieces) + 1, 2))
    p[1:] = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    model = language.Model(["x", "y"], pieces, p)
    texts = ["abcab", "AB", "", "a b", None, "zé"]
    got = model.log_texts(pa.array(texts, pa.string()))
    place = {q: k + 1 for k, q in enumerate(pieces)}
    for text, row in zip(texts, got):
        for k in (0, 1):
            want = 0.0
            for word in (text or "").lower().split():
                raw, total = b" " + word.encode(), 0.0
                for cuts in itertools.product([0, 1], repeat=len(raw) - 1):
                    bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(raw)]
                    parts = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
                    total += math.prod(p[place[q], k] if q in place else 0 for q in parts)
                want += math.log(total)
            assert row[k] == pytest.approx(want, rel=1e-9)


def test_long_words_lose_nothing_where_they_are_cut():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"cabca", b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcab", b"b" * 20]
    p = np.zeros((len(pieces) + 1, 2))
    p[1:] = np.random.default_rng(3).dirichlet(np.ones(len(pieces)), 2).T
    model, rnd = language.Model(["x", "y"], pieces, p), random.Random(4)
    texts = ["abc" * 40, "b" * 33, "b" * 64, "b" * 65, "b" * 333, "Abc" * 11, *("".join(rnd.choices("abcb", k=rnd.randint(1, 200))) for _ in range(40)), "x y " + "abc" * 700]
    got = model.log_texts(pa.array(texts))
    for text, row in zip(texts, got):
        for k in (0, 1):
            want = 0.0
            for word in text.lower().split():
                raw = b" " + word.encode()
                alpha = [0.0]  # logarithms
                for e in range(1, len(raw) + 1):
                    terms = [alpha[e - len(q)] + math.log(p[j + 1, k]) for j, q in enumerate(pieces) if raw[max(0, e - len(q)) : e] == q]
                    top = max(terms)
                    alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
                want += alpha[-1]
            assert row[k] == pytest.approx(want, rel=1e-9)


def test_expected_counts_raise_the_likelihood():
    words = [b"banana", b"bandana", b"ananas", b"x" * 40]
    counts = np.array([[5, 1], [2, 0], [1, 7], [1, 1]], float)
    pieces = [bytes([b]) for b in range(256)] + [b" ban", b"ana", b"an", b"nas"]
    likelihood = []
    for rounds in (1, 2, 4, 8):
        model = language.fit(["x", "y"], words, counts, pieces, rounds)
        raw, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
        likelihood.append((model.log_words(raw, ends - [len(w) for w in words], ends) * counts).sum())
    assert likelihood == sorted(likelihood)


def test_languages_of_held_out_texts(spark):
    rnd = random.Random(1)
    sounds = {"aa": ["ka", "mo", "ti"], "bb": ["sch", "ung", "er"], "cc": ["é", "aux", "oi"]}
    say = lambda lang, n: " ".join("".join(rnd.choices(sounds[lang], k=3)) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i in range(240) for lang in [sorted(sounds)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 -- 3", "bb"), (None, say("bb", 9), None), (1003, say("cc", 4000), None), (1, rows[1][1], "bb")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    model = language.train(language.labelled(docs), language.model_path())
    found = language.predict(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            assert r.lang_pred == r.lang and 0 <= r.score <= 1
    nothing = language.predict(docs.limit(5), language.train(language.labelled(docs.limit(0)), language.model_path())).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_gradients_against_differences():
    texts = toxicity.Texts(pa.array(["a b c d e " * 9, "b c x", "q"]))
    net = toxicity.Network(texts.distinct[:4], np.array([1.0, -1, 2, 0]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    some, labels = np.arange(len(texts.begin)), np.array([1, 0, 1, 0, 1, 0])[: len(texts.begin)]
    weights = np.ones(2)
    keep, toxicity.DOUBT = toxicity.DOUBT, 0.0
    try:
        g = net.gradients(texts, net.inputs(texts), some, labels, weights)

        def loss():
            p = toxicity.sigmoid(net.run(net.projected(net.inputs(texts)), *texts.rows(some))[0].astype(np.float64))
            return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

        for k in ("u", "v", "A", "Wf", "Wb", "Uf", "Ub", "cf", "cb", "b"):
            flat = net.p[k].reshape(-1)
            i = len(flat) // 2
            flat[i] += 1e-2
            up = loss()
            flat[i] -= 2e-2
            down = loss()
            flat[i] += 1e-2
            assert g[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-2, abs=2e-4), k
    finally:
        toxicity.DOUBT = keep


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        texts = toxicity.Texts(pa.array([" ".join(["w"] * n), "x"]))
        seen = set()
        for a, b in zip(texts.begin[texts.text == 0], texts.stop[texts.text == 0]):
            assert b - a <= toxicity.WINDOW
            seen |= set(range(a, b))
        assert seen == set(range(n))


def test_toxic_texts_are_found_wherever_the_words_are(spark):
    rnd = random.Random(4)
    calm = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(400):
        words = rnd.choices(calm, k=rnd.randint(5, 400))
        toxic = int(i % 5 == 0)
        for _ in range(2 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(["vile", "rotten", "nasty"])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net, share = toxicity.train(docs, docs.filter("doc_id % 4 <> 2").select("doc_id", "toxic"))
    held = spark.createDataFrame([(i, t, "x") for i, t, _ in rows if i % 4 == 2] + [(None, None, "x"), (-1, "", "x"), (-2, " ".join(calm * 20) + " vile rotten", "x")], "doc_id long, text string, score string")
    found = {r.doc_id: r for r in toxicity.score_texts(held, net, share).collect()}
    wrong = sum(found[i].predicted != y for i, _, y in rows if i % 4 == 2)
    assert wrong <= 3 and found[-2].predicted == 1
    assert found[None].score == found[-1].score == share
    assert toxicity.train(docs, docs.filter("toxic = 0"))[0] is None
    assert toxicity.score_texts(held.limit(0), net, share).count() == 0


def test_gradients_reach_words_and_trigrams():
    texts = toxicity.Texts(pa.array(["abc cab bca abc " * 9, "abc xyz", "q"]))
    net = toxicity.Network(texts.distinct[:3], np.array([1.0, -1, 2]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    some, labels = np.arange(len(texts.begin)), np.array([1, 0, 1, 0, 1, 0])[: len(texts.begin)]
    keep, toxicity.DOUBT = toxicity.DOUBT, 0.0
    try:
        g = net.gradients(texts, net.inputs(texts), some, labels, np.ones(2))

        def loss():
            p = toxicity.sigmoid(net.run(net.projected(net.inputs(texts)), *texts.rows(some))[0].astype(np.float64))
            return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

        for k, row in [("word", 0), ("word", 1), ("word", 2), *(("gram", i) for i in np.unique(texts.gram))]:
            for i in (0, toxicity.WIDTH - 1):
                net.p[k][row, i] += 1e-2
                up = loss()
                net.p[k][row, i] -= 2e-2
                down = loss()
                net.p[k][row, i] += 1e-2
                assert g[k][row, i] == pytest.approx((up - down) / 2e-2, abs=2e-4), (k, row)
    finally:
        toxicity.DOUBT = keep


def test_toxic_stems_are_found_in_words_never_seen():
    rnd = random.Random(8)
    ending = lambda: "".join(rnd.choices("abcdefghijklm", k=5))
    texts, labels = [], []
    for i in range(500):
        words = rnd.choices([f"word{k}" for k in range(200)], k=rnd.randint(10, 60))
        for _ in range(3):  # each word once in all texts, so that none has an embedding of its own
            words[rnd.randrange(len(words))] = ("vilnus" if i % 3 == 0 else "gentor") + ending()
        texts.append(" ".join(words)), labels.append(int(i % 3 == 0))
    labels = np.array(labels)
    net = toxicity.fit(pa.array(texts[:300]), labels[:300])
    held = toxicity.Texts(pa.array(texts[300:]))
    top = np.maximum.reduceat(net.logits(held), np.cumsum(held.windows) - held.windows)
    assert ((top > 0) == labels[300:]).mean() > 0.95
