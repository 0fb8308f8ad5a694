import random

from tests.llm.test_pipeline import prose
from tidyfold.llm import decontaminate


def shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    out = []
    for i, text in docs:
        own = shingles(text)
        for j, item in dict.fromkeys(items):
            s = shingles(item)
            if s and 100 * len(s & own) >= 75 * len(s):
                out.append((i, j, len(s), len(s & own)))
    return sorted(map(repr, out))


def check(spark, docs, items):
    got = decontaminate.contained(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(repr((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared)) for r in got.collect()) == brute(docs, items)


def test_items_in_long_and_short_documents(spark, monkeypatch):
    rnd = random.Random(1)
    items = [(k, prose(f"i{k}", rnd.choice([1, 3, 4, 5, 6, 9, 17, 40, 200]))) for k in range(40)]
    docs = []
    for i in range(60):
        words = prose(f"d{i}", rnd.choice([2, 30, 400])).split()
        item = items[i % 40][1].split()
        for at in range(len(item)):
            if rnd.random() < (i % 4) * 0.03:
                item[at] = "changed"
        docs.append((i, " ".join(words + item + words[::-1]) if i % 5 else " ".join(item).upper()))
    check(spark, docs, items)
    monkeypatch.setattr("tidyfold.llm.common.BROADCAST_ROWS", 0)
    check(spark, docs, items)


def test_nulls_empty_and_repeats(spark):
    text = prose("t", 20)
    check(spark, [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "a b"), (5, text * 50)], [(1, text), (1, text), (None, prose("u", 9)), (2, None), (3, " "), (4, "A  b")])
    check(spark, [(1, text)], [])
    check(spark, [], [(1, text)])
