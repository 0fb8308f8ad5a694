import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidyfold.llm import suffixdedup
from tidyfold.llm.induced import permuted_prefixes, suffix_array


def brute(rows, length=suffixdedup.LENGTH):
    texts = [(2**63 if i is None else i, i, (t or "").encode()) for i, t in rows]
    least = {}
    for key, _, raw in texts:
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            least[w] = min(least.get(w, key), key)
    out = []
    for key, i, raw in texts:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < key:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(spark, rows):
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, ((*r[:5], bytes(r.kept)) for r in got.collect()))) == sorted(map(repr, brute(rows)))


def texts(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(5, 40))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 20)
            parts += [p[a : a + rnd.randint(20, 300)], word()]
        out.append((i * 3 % n, " ".join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_follow_the_definition(spark, seed):
    rows = texts(seed, 61)
    check(spark, rows + [(1000, rows[5][1]), (1001, rows[5][1]), (5, "x" * 200), (4, "x" * 49), (6, "x" * 50), (7, "x" * 51 + "y")])


def test_nulls_empty_repeats_and_ties(spark):
    long = "Lorem ipsum " * 20
    check(spark, [(1, None), (2, ""), (3, long), (3, long), (None, long), (None, "short"), (4, long[7:90] + "\x00" + long), (9, "ab" * 3000)])
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 3000)
    rows = texts(3, 90)
    bounds = np.cumsum([0, *(len(t.encode()) for _, t in rows)])
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    whole = suffixdedup.records(raw, bounds)
    monkeypatch.setattr(suffixdedup, "_SLICE", 700)
    cut = suffixdedup.records(raw, bounds)
    assert whole[1].sum() == cut[1].sum() and set(whole[2].tolist()) == set(cut[2].tolist())
    # Shards are chosen by the driver, so many of them meet the blocks of several partitions here.
    total = sum(len(t.encode()) for _, t in rows)
    assert total // suffixdedup.SHARD_BYTES > 5
    check(spark, rows)


def test_extra_columns_with_clashing_names(spark):
    long = "one and the same passage that is longer than fifty bytes in all"
    docs = spark.createDataFrame([(1, long, "a", 7, "x"), (2, long + " end", "b", 8, "y")], "doc_id long, text string, kept string, n_bytes int, shard string")
    got = sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffixdedup.remove_repeats(docs).select("doc_id", "n_removed", "kept").collect())
    assert got == [(1, 0, long.encode()), (2, len(long), b" end")]


def test_blocks_go_on_over_batches(monkeypatch):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 1000)
    rnd = random.Random(5)
    sizes = [rnd.choice([0, 1, 90, 300, 1000, 2500]) for _ in range(200)]
    rows = [(i, i if i % 7 else None, "xyé"[i % 3] * n if n else None, {"extra": i}) for i, n in enumerate(sizes)]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["row", "doc_id", "text", "others"])
    for step in (1, 7, 200):
        blocks = pa.Table.from_batches(suffixdedup._pack(whole.slice(a, step) for a in range(0, 200, step))).to_pylist()
        texts, held = [], [sum(b["sizes"]) for b in blocks]
        for b in blocks:
            raw, at = suffixdedup._expand(b["packed"], np.uint8).tobytes(), np.cumsum([0, *b["sizes"]])
            texts += [raw[x:y].decode() for x, y in zip(at[:-1], at[1:])]
            assert b["block"] == b["others"][0]["extra"] and (sum(b["sizes"]) <= 1000 or len(b["sizes"]) == 1)
        assert texts == [t or "" for _, _, t, _ in rows]
        assert [i for b in blocks for i in b["ids"]] == [i for _, i, _, _ in rows] and [o for b in blocks for o in b["others"]] == [o for *_, o in rows]
        # However the rows come, a block ends only where the next text doesn't fit; the old one ended with each batch.
        assert all(a + b["sizes"][0] > 1000 for a, b in zip(held, blocks[1:]))


def test_text_is_decoded_where_it_is_cut(spark):
    """As a second Python step behind the first, decoding kept two more workers on every executor of two cores."""
    line = "one and the same passage that is longer than fifty bytes, with an é"
    # The repeated windows end within a character: é and è share their first byte.
    docs = spark.createDataFrame([(1, "a " + line, 7), (2, "b " + line[:-1] + "è end", 8), (3, None, 9)], "doc_id long, text string, n_chars long")
    raw = {r.doc_id: bytes(r.kept) for r in suffixdedup.remove_repeats(docs).collect()}
    assert raw[2] == b"b\xa8 end"
    found = corpus_pipeline.repeated_strings(spark, docs, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
    assert sorted(map(tuple, found.collect())) == [(1, "a " + line, len(line) + 2), (2, "b end", 5), (3, "", 0)]


def test_grams_of_contents_need_no_room_for_all(monkeypatch):
    rnd = np.random.default_rng(6)
    count = rnd.integers(1, suffixdedup.WINDOWS + 1, 3000)
    starts = np.cumsum(count + suffixdedup.LENGTH - 1) - count - suffixdedup.LENGTH + 1
    raw = rnd.integers(97, 100, int((count + suffixdedup.LENGTH - 1).sum())).astype(np.uint8)
    want = np.array([(suffixdedup.gram_hashes(raw[a : a + c + suffixdedup.LENGTH - 1]) & ~np.uint64(0xFFFFF)).min() for a, c in zip(starts, count)])
    longest = []
    monkeypatch.setattr(suffixdedup, "_SLICE", 5000)
    monkeypatch.setattr(suffixdedup, "gram_hashes", lambda part, f=suffixdedup.gram_hashes: longest.append(len(part)) or f(part))
    assert (suffixdedup._content_owners(raw, starts, count) == want).all() and max(longest) < 5000 + 2 * suffixdedup.LENGTH


def test_suffixes_are_in_order():
    rnd = random.Random(4)
    for _ in range(40):
        parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 9))]
        text = np.array([c for p in parts for c in [*(ord(x) - 96 for x in p), 0]], np.int16)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        begin = np.zeros(len(text), bool)
        begin[starts] = True
        order = suffix_array(text, begin, 3)
        suffix = lambda i: text[i : i + text[i:].tolist().index(0) + 1].tolist()
        found = [suffix(i) for i in order]
        assert found == sorted(found) and sorted(order) == list(range(len(text)))
        prefix = permuted_prefixes(text, starts, order, 12)
        for a, b, i in zip(found, found[1:], order[1:]):
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y or x == 0), min(len(a), len(b)))
            assert prefix[i] == min(n, 12)


def test_only_contents_that_can_share_a_window_are_sorted(monkeypatch):
    """Of many contents around one K-gram, those with the same string about it go on; the answers are those of brute force."""
    length, k, rng = suffixdedup.LENGTH, suffixdedup.K, np.random.default_rng(5)
    gram = b"m" * k
    parts = [rng.bytes(40) + gram + rng.bytes(40) for _ in range(30)]
    near, before = rng.bytes(40), rng.bytes(7)
    parts += [rng.bytes(33) + before + gram + near, rng.bytes(30) + before + gram + near[:30] + rng.bytes(3)]
    monkeypatch.setattr(suffixdedup, "gram_hashes", lambda raw: _least_at(raw, gram, k))
    texts, counts = [], []
    for part in parts:  # the windows that hold the gram
        at = part.index(gram)
        text = part[max(0, at - (length - k)) : at + length]
        texts.append(text), counts.append(len(text) - length + 1)
    sorted_ = []
    whole = suffixdedup.least_owners
    monkeypatch.setattr(suffixdedup, "least_owners", lambda raw, count, low: sorted_.append(len(count)) or whole(raw, count, low))
    packed = suffixdedup._press(np.frombuffer(b"".join(texts), np.uint8))
    low = np.arange(len(parts), 0, -1)
    group = pa.table({"shard": pa.array([0], pa.int32()), "block": pa.array([0], pa.int64()), "texts": pa.array([packed], pa.binary()),
                      "counts": pa.array([np.array(counts, np.uint8).tobytes()], pa.binary()), "low": pa.array([suffixdedup._press(low)], pa.binary())})
    raw = suffixdedup._answer(group).column("least")[0].as_py()
    n, both = int.from_bytes(raw[:4], "little"), suffixdedup._expand(raw[4:], np.int64)
    least = {}
    for text, i in zip(texts, low.tolist()):
        for p in range(len(text) - length + 1):
            least[text[p : p + length]] = min(i, least.get(text[p : p + length], i))
    assert np.repeat(both[n:], both[:n]).tolist() == [least[t[p : p + length]] for t in texts for p in range(len(t) - length + 1)]
    assert len(least) < sum(counts) and sorted_ == [2]


def _least_at(raw, gram, k):
    """Hashes of K-grams, of which `gram` has the least."""
    rows = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(raw), k)
    return np.where((rows == np.frombuffer(gram, np.uint8)).all(axis=1), np.uint64(0), np.uint64(1 << 40) + (rows.astype(np.uint64) @ np.arange(1, k + 1, dtype=np.uint64) << np.uint64(20)))
