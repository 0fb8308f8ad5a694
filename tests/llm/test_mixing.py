import pytest
from pyspark.sql import functions as F

from tidyfold.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The contract's resharing, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]} if free else set()
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = targets({s: sum(r.size for r in g) for s, g in by.items()})
    for s, g in by.items():
        size = sum(r.size for r in g)
        assert {r.source_size for r in g} == {size}
        assert all(r.target == pytest.approx(want[s]) for r in g)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in g)
        assert abs(sum(r.taken for r in g) - want[s]) <= 2 * max(r.size for r in g) + 1e-6
        assert abs(sum(r.copies for r in g) - len(g) * (want[s] / size if size else 0)) < 1


@pytest.mark.parametrize("bucket", [50_000, 5])
def test_targets_and_copies(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), None if i % 11 == 0 else f"s{i % 7 if i % 3 else 0}", "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    one, two = mixing.mix_sources(docs).collect(), mixing.mix_sources(docs.repartition(5)).collect()
    check(one)
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and len(one) == 400


def test_nulls_empty_and_repeats(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (None, "x y", None), (3, " \t\x0b ", "b"), (4, "  q", "b"), (4, "  q", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs).collect()
    check(found)
    assert sorted(r.size for r in found) == [0, 0, 0, 0, 2, 2, 2]
    assert mixing.mix_sources(docs.filter("doc_id < 0")).count() == 0
    assert mixing.mix_sources(docs.filter("doc_id = 1")).agg(F.sum("taken")).first()[0] == 0
