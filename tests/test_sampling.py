import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyfold.operators import sampling


def drawn(spark, samples, n, k, seed=1, hash_fn="xxhash64"):
    rows = spark.range(samples).select(F.col("id").alias("sample"))
    return {r["sample"]: r["p"] for r in rows.select("sample", sampling.keyed_positions(n, k, seed, F.col("sample"), hash_fn=hash_fn).alias("p")).collect()}


@pytest.mark.parametrize(("n", "k"), [(1, 1), (2, 1), (3, 3), (10, 4), (17, 17), (50, 12), (90, 0), (101, 100), (2000, 300)])
def test_keyed_positions_are_k_distinct_ones(spark, n, k):
    for hash_fn in ("xxhash64", "md5"):
        for found in drawn(spark, 20, n, k, hash_fn=hash_fn).values():
            assert len(found) == len(set(found)) == k
            assert not found or (min(found) >= 0 and max(found) < n)


def test_keyed_positions_are_even_and_pairs_too(spark):
    n, k, samples = 23, 6, 6000
    hits = np.zeros((samples, n))
    for s, found in drawn(spark, samples, n, k, seed=9).items():
        hits[s, found] = 1
    share = k / n
    assert np.abs(hits.mean(0) - share).max() < 5 * np.sqrt(share * (1 - share) / samples)
    pairs = (hits.T @ hits / samples)[np.triu_indices(n, 1)]
    wanted = k * (k - 1) / (n * (n - 1))
    assert np.abs(pairs - wanted).max() < 5.5 * np.sqrt(wanted * (1 - wanted) / samples)


def test_keyed_positions_rerun_alike_and_differ_by_seed_and_sample(spark):
    one, again, other = drawn(spark, 5, 1000, 50), drawn(spark, 5, 1000, 50), drawn(spark, 5, 1000, 50, seed=2)
    assert one == again
    assert all(one[s] != other[s] for s in one)
    assert len({tuple(p) for p in one.values()}) == 5


def test_too_many_positions_fail():
    with pytest.raises(ValueError, match="can't be drawn"):
        sampling.keyed_positions(3, 4, 0)


def test_masks_reach_zeros_that_are_not_stored(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "c", 3.0), (2, "a", 5.0)], "sample int, feature string, value double")
    axis = spark.createDataFrame(list(enumerate("abcd")), "position int, feature string")
    samples = spark.createDataFrame([(1,), (2,), (3,), (3,)], "sample int")
    found = sampling.mask_everywhere(rows, sampling.masked_positions(samples, "sample", 4, 2, 5), axis, "sample").collect()
    keys = [(r["sample"], r["feature"]) for r in found]
    assert len(keys) == len(set(keys))
    stored = {(1, "b"): 2.0, (1, "c"): 3.0, (2, "a"): 5.0}
    assert set(stored) <= set(keys)
    for r in found:
        assert r["value"] == stored.get((r["sample"], r["feature"]), 0.0)
        assert r["mask"] or (r["sample"], r["feature"]) in stored
    assert {s: sum(r["mask"] for r in found if r["sample"] == s) for s in (1, 2, 3)} == {1: 2, 2: 2, 3: 2}
    every = sampling.bernoulli_positions(samples, "sample", 4, 1.0)
    assert sampling.mask_everywhere(rows, every, axis, "sample").filter("mask").count() == 12
    assert sampling.mask_everywhere(rows.limit(0), every.limit(0), axis, "sample").count() == 0


@pytest.mark.parametrize("hash_fn", ["xxhash64", "md5"])
def test_lists_hold_the_same_positions_and_are_dealt_over_tasks(spark, hash_fn):
    samples = spark.createDataFrame([(s,) for s in (1, 2, 3, 3, None)], "sample int")
    for n, k in ((1, 1), (7, 0), (10, 4), (1000, 150)):
        rows = sampling.masked_lists(samples, "sample", n, k, 5, hash_fn)
        wanted = samples.distinct().select("sample", sampling.keyed_positions(n, k, 5, F.col("sample"), hash_fn=hash_fn).alias("p")).collect()
        assert {r["sample"]: r["positions"] for r in rows.collect()} == {r["sample"]: r["p"] for r in wanted}
    every = samples.distinct().select("sample", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("position"))
    hit = every.filter(sampling.bernoulli(0.15, 6, F.col("sample"), F.col("position"), hash_fn=hash_fn))
    found = sampling.bernoulli_positions(samples, "sample", 200, 0.15, 6, hash_fn)
    assert sorted(map(str, found.collect())) == sorted(map(str, hit.collect()))
    for drawn in (sampling.masked_positions(samples, "sample", 1000, 150, 5, hash_fn), found):
        assert drawn.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_bernoulli_bound_is_the_first_draw_not_below_the_rate():
    for rate in (0.0, 0.15, 0.3, 1 / 3, 1.0):
        cut = sampling._first_above(rate)
        assert float(cut) / sampling.SPAN >= rate and (cut == 0 or float(cut - 1) / sampling.SPAN < rate)


def test_masks_by_lists_and_by_rows_are_the_same(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "b", 7.0), (1, "c", None), (2, "a", 5.0), (9, "d", 1.0), (2, "z", 4.0), (None, "a", 3.0)], "sample int, feature string, value double")
    axis = spark.createDataFrame([*enumerate("abcd"), (1, "b")], "position int, feature string")
    samples = spark.createDataFrame([(1,), (2,), (3,), (None,)], "sample int")
    for drawn in (sampling.masked_lists(samples, "sample", 5, 3, 5), sampling.bernoulli_lists(samples, "sample", 5, 0.5, 2, "md5"), sampling.masked_lists(samples, "sample", 5, 0)):
        tidy = drawn.select("sample", F.explode("positions").alias("position"))
        found, wanted = ([tuple(r) for r in sampling.mask_everywhere(rows, p, axis, "sample").collect()] for p in (drawn, tidy))
        assert sorted(found, key=str) == sorted(wanted, key=str)


def test_positions_are_drawn_where_they_are_opened(spark):
    """Only ids and stored values are shuffled, whatever the grid; rows and more draws are those of lists that meet them."""
    from tidyfold.functions.hashing import md5_hash

    rows = spark.createDataFrame([(1, "b", 2.0), (1, "b", 7.0), (1, "c", None), (2, "a", 5.0), (9, "d", 1.0), (2, "z", 4.0), (None, "a", 3.0)], "sample int, feature string, value double")
    axis = spark.createDataFrame([*enumerate("abcd"), (1, "b"), (2, None)], "position int, feature string")
    samples = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "sample int")
    for make, lists, args in ((sampling.masked_draws, sampling.masked_lists, (5, 3, 5, "md5")), (sampling.masked_draws, sampling.masked_lists, (5, 3, 5)), (sampling.masked_draws, sampling.masked_lists, (5, 0)),
                              (sampling.bernoulli_draws, sampling.bernoulli_lists, (5, 0.5, 2, "md5")), (sampling.bernoulli_draws, sampling.bernoulli_lists, (5, 0.5, 2))):
        found = sampling.mask_everywhere(rows, make(samples, "sample", *args), axis, "sample", draws={"_d": 8})
        wanted = sampling.mask_everywhere(rows, lists(samples, "sample", *args), axis, "sample")
        wanted = wanted.withColumn("_d", F.when(F.col("mask"), md5_hash(8, F.col("sample"), F.col("feature"))))
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    plan = sampling.mask_everywhere(rows, sampling.masked_draws(samples, "sample", 5, 3), axis, "sample")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0]


def test_marginal_draws_do_not_shuffle_the_entries(spark):
    train = spark.createDataFrame([(s, f, float(10 * s + f)) for s in range(1, 9) for f in range(6) if (s + f) % 3], "sample int, feature int, value double")
    pool = sampling.number_pool(train.select("sample"), "sample")
    rows = spark.range(300).select((F.col("id") % 50).alias("sample"), (F.col("id") % 7).cast("int").alias("feature"))
    found = sampling.marginal_draws(rows, train, pool, "sample", seed=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [feature" in plan and "SortMergeJoin [pool_row" not in plan
    numbered = {r["pool_row"]: r["pool_sample"] for r in pool.collect()}
    stored = {(r["sample"], r["feature"]): r["value"] for r in train.collect()}
    picked = rows.select("sample", "feature", sampling.choice(4, F.lit(len(numbered)), F.col("sample"), F.col("feature")).alias("p")).collect()
    wanted = sorted((r["sample"], r["feature"], stored.get((numbered[r["p"]], r["feature"]), 0.0)) for r in picked)
    assert sorted(map(tuple, found.select("sample", "feature", "replacement").collect())) == wanted
    twice = sampling.marginal_draws(rows, train.unionByName(train), pool, "sample", seed=4)
    assert twice.count() == sum(1 + (r[2] > 0) for r in wanted)
