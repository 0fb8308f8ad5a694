import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyfold.operators import ordering


def skewed(spark, seed=0, n=600):
    """One key holds two thirds of the rows, and a third of its values are one tie."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.67, 0, rng.integers(1, 6, n))
    values = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(0, 10, n), 1))
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(keys, values, strict=True))]
    return rows, spark.createDataFrame(rows, "k int, v double, i int")


def test_prefix_sums_match_a_sort(spark):
    rows, df = skewed(spark)
    for cuts in ([], ordering.cut_points(df, "v", 16)):
        for descending in (False, True):
            out = ordering.prefix_sums(df, ["k"], "v", {"n": F.lit(1), "s": F.col("i")}, cuts, descending).collect()
            assert len(out) == len({(k, v) for k, v, _ in rows})
            for r in out:
                same = [i for k, v, i in rows if k == r["k"] and v == r["v"]]
                before = [i for k, v, i in rows if k == r["k"] and (v > r["v"] if descending else v < r["v"])]
                assert (r["n"], r["s"]) == (len(same), sum(same))
                assert (r["n_before"], r["s_before"]) == (len(before), sum(before))
                assert r["n_all"] == sum(k == r["k"] for k, _, _ in rows)


def test_quantiles_match_numpy(spark):
    rows, df = skewed(spark, 1)
    out = ordering.exact_quantiles(df, ["k"], "v", {"a": 0.025, "b": 0.5, "c": 0.99}, ordering.cut_points(df, "v", 8))
    for r in out.collect():
        here = [v for k, v, _ in rows if k == r["k"]]
        np.testing.assert_allclose([r["a"], r["b"], r["c"]], np.percentile(here, [2.5, 50, 99]), atol=1e-9)


def test_weighted_quantiles_count_repeats(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 2)], "v double, w int")
    out = ordering.exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.7}, [1.5], F.col("w")).first()
    np.testing.assert_allclose([out["m"], out["q"]], np.percentile([1, 1, 1, 2, 10, 10], [50, 70]))


def test_full_ranks_match_a_stable_sort(spark):
    rows, df = skewed(spark, 2)
    cuts, ties = ordering.cut_points(df, "v", 8), ordering.cut_points(df, "i", 8)
    for r in ordering.rank_rows(df, ["k"], "v", "i", cuts, ties).collect():
        ahead = sum(k == r["k"] and (v > r["v"] or (v == r["v"] and i < r["i"])) for k, v, i in rows)
        assert r["rank"] == ahead


def test_hash_rank_is_a_permutation_within_the_key(spark):
    from tidyfold.functions.hashing import md5_hex

    _, df = skewed(spark, 3)
    out = ordering.hash_rank(df.withColumn("h", md5_hex(F.col("i"))), ["k"], "h", "i").toPandas()
    for _, part in out.groupby("k"):
        assert part.sort_values(["h", "i"])["rank"].tolist() == list(range(len(part)))
        assert set(part["size"]) == {len(part)}


def test_top_k_salted_equals_plain(spark):
    rows, df = skewed(spark, 4)
    order = [F.desc("v"), F.asc("i")]
    for k in (3, 100):
        plain = {tuple(r) for r in ordering.top_k(df, ["k"], order, k).collect()}
        salted = {tuple(r) for r in ordering.top_k(df, ["k"], order, k, salt="i").collect()}
        assert plain == salted
        assert len(plain) == sum(min(k, sum(x[0] == key for x in rows)) for key in {x[0] for x in rows})


def test_running_min(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 3.0), (3.0, 4.0), (4.0, 9.0)], "o double, v double")
    for cuts in ([], [2.5], [1.5, 2.0, 3.5]):
        out = {r["o"]: r["v"] for r in ordering.running_min(df, [], "o", "v", cuts).collect()}
        assert out == {1.0: 3.0, 2.0: 3.0, 3.0: 4.0, 4.0: 9.0}


def test_radix_selection_matches_numpy_over_signs_scales_ties_and_weights(spark):
    rng = np.random.default_rng(8)
    groups = {
        "wide": np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), np.zeros(40)]),
        "close": 1.0 + np.arange(500) * 2.0**-52, "tied": np.repeat([-2.5, 3.0], [7, 8]), "one": np.array([4.0]), "zero": np.zeros(5),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.993, "e": 1.0}
    found = {r["k"]: r for r in ordering.selected_quantiles(df, ["k"], "v", probs).collect()}
    assert set(found) == set(groups)
    for k, v in groups.items():
        for name, p in probs.items():
            assert found[k][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=0), (k, name)
    weighted = spark.createDataFrame([(-1.0, 3), (0.0, 5), (2.0, 0), (7.0, 4)], "v double, w long")
    out = ordering.selected_quantiles(weighted, [], "v", {"m": 0.5, "q": 0.7}, F.col("w")).first()
    every = np.repeat([-1.0, 0.0, 7.0], [3, 5, 4])
    assert (out["m"], out["q"]) == (np.quantile(every, 0.5), pytest.approx(np.quantile(every, 0.7)))
