import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyfold.functions import hashing
from tidyfold.operators import blocks, bootstrap, checks, factorize, linear, metrics, neighbours, survival


def vectors(spark, x, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in row], *[columns[c][i] for c in names]) for i, row in enumerate(np.asarray(x).tolist())]
    return spark.createDataFrame(rows, ["id", "x", *names])


def test_ridge_leave_one_out_equals_refitting(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(25, 4)) * [1, 5, 0.1, 2], rng.normal(size=(4, 2))
    y = x @ w + rng.normal(size=(25, 2)) + 3
    df = vectors(spark, x, y=y.tolist(), fold=[0] * 25)
    fits = linear.fit_ridges(df, "x", "y", "fold", (0.1, 10.0, 1000.0))
    fit = fits[0]
    z = (x - x.mean(0)) / x.std(0)
    errors = []
    for a in (0.1, 10.0, 1000.0):
        total = 0.0
        for i in range(25):
            keep = np.arange(25) != i
            zc, yc = z[keep] - z[keep].mean(0), y[keep] - y[keep].mean(0)
            coef = np.linalg.solve(zc.T @ zc + a * np.eye(4), zc.T @ yc)
            total += ((y[i] - y[keep].mean(0) - (z[i] - z[keep].mean(0)) @ coef) ** 2).sum()
        errors.append(total / 50)
    np.testing.assert_allclose(fit.errors, errors, rtol=1e-8)
    assert fit.alpha == (0.1, 10.0, 1000.0)[int(np.argmin(errors))]
    pred = linear.predict_ridges(df, fits, "x", "fold").orderBy("id").toPandas()["pred"]
    np.testing.assert_allclose(linear.stack(pred), fit.predict(x))
    tiled = linear.fit_ridges(df, "x", "y", "fold", (0.1, 10.0, 1000.0), targets=1)  # a tile for each target
    assert len(tiled.tiles) == 2 and tiled[0].alpha == fit.alpha
    np.testing.assert_allclose(tiled[0].errors, errors, rtol=1e-8)
    np.testing.assert_allclose(linear.stack(linear.predict_ridges(df, tiled, "x", "fold").orderBy("id").toPandas()["pred"]), fit.predict(x))


def test_pca_ignores_held_out_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6)) * [9, 6, 3, 1, 0.5, 0.1]
    df = vectors(spark, x, train=[i < 30 for i in range(40)])
    got = linear.stack(linear.pca_embeddings(df, "x", "train", 3).orderBy("id").toPandas()["embedding"])
    centred = x[:30] - x[:30].mean(0)
    _, s, v = np.linalg.svd(centred)
    np.testing.assert_allclose(np.linalg.norm(got[:30], axis=0), s[:3], rtol=1e-8)
    axes = linear.fixed_signs(v[:3].T)
    np.testing.assert_allclose(got, (x - x[:30].mean(0)) @ axes, atol=1e-8)


@pytest.mark.parametrize("n, rows, k", [(6, 40, 3), (90, 500, 5), (300, 120, 140), (200, 900, 70)])
def test_lanczos_finds_the_leading_pairs(n, rows, k):
    y = np.random.default_rng(n).normal(size=(n, rows)) * np.linspace(4, 1, n)[:, None]
    values, u = blocks.leading(lambda q: y @ (y.T @ q), n, k)
    left, s, _ = np.linalg.svd(y, full_matrices=n > rows)
    s = np.append(s, np.zeros(max(0, k - len(s))))[: min(k, n)]
    np.testing.assert_allclose(values, s**2, atol=1e-8 * s[0] ** 2)
    some = min(k, rows, 20)
    np.testing.assert_allclose(np.abs((u[:, :some] * left[:, :some]).sum(axis=0)), 1, atol=1e-6)


def test_lanczos_restarts_in_little_room(monkeypatch):
    y = np.random.default_rng(3).normal(size=(150, 600)) * np.linspace(5, 1, 150)[:, None]
    monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "BASIS_CELLS", 1)
    values, _ = blocks.leading(lambda q: y @ (y.T @ q), 150, 4)
    np.testing.assert_allclose(values, np.linalg.svd(y, compute_uv=False)[:4] ** 2, rtol=1e-8)


def test_singular_values_by_either_side_and_gram_tiles(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(30, 12))
    want = np.linalg.svd(x, compute_uv=False)
    monkeypatch.setattr(blocks, "ROWS", 7)
    for m in (x, x.T):
        packed = blocks.pack(vectors(spark, m), ["x"])
        np.testing.assert_allclose(linear.singular_values(packed, "x"), want, rtol=1e-8)
    packed = blocks.pack(vectors(spark, x, g=[i % 3 for i in range(30)]), ["x"], F.col("g"))
    for k, g in blocks.gram(packed, "x", tile=5).items():
        one = np.hstack([np.ones((10, 1)), x[k::3]])
        np.testing.assert_allclose(g, one.T @ one, atol=1e-12)
    with pytest.raises(Exception, match="ragged"):
        blocks.pack(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"), ["x"])


def test_lvs_are_swept_together_or_apart(spark, monkeypatch):
    rng = np.random.default_rng(21)
    c = (rng.random((40, 9)) < 0.4).astype(float)
    ctz, gram = c.T @ rng.random((40, 7)), c.T @ c
    whole = factorize.u_step(spark, ctz, gram, 2.0, np.zeros((9, 7)))
    monkeypatch.setattr(factorize, "SWEEP", 2)
    np.testing.assert_allclose(factorize.u_step(spark, ctz, gram, 2.0, np.zeros((9, 7))), whole, atol=1e-6)
    each = np.hstack([factorize.nonnegative_lasso(ctz[:, [j]], gram, 2.0, np.zeros((9, 1))) for j in range(7)])
    np.testing.assert_allclose(whole, each, atol=1e-6)
    assert (whole > 0).any()


@pytest.mark.parametrize("hash_fn", ["md5", "xxhash64"])
def test_draws_travel_as_blocks_of_counts(spark, monkeypatch, hash_fn):
    """Small blocks, chunks and tasks give the draws of the definition."""
    monkeypatch.setattr(bootstrap, "BLOCK", 7)
    monkeypatch.setattr(bootstrap, "DRAWS_HELD", 9)
    monkeypatch.setattr(bootstrap, "DRAWS_AT_ONCE", 5)
    rows = spark.createDataFrame([(f"c{i % 23}",) for i in range(60)] + [(None,)], "case string")
    ranks = {r["case_rank"]: r["case"] for r in bootstrap.number_cases(rows, "case").collect()}
    ids = spark.range(1, 5).select(F.col("id").cast("int").alias("r")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    picked = ids.select("r", F.pmod(hashing.draw(6, F.col("r"), F.col("i"), hash_fn=hash_fn), F.lit(24)).alias("k")).collect()
    wanted = Counter((r["r"], ranks[r["k"]]) for r in picked) + Counter((0, c) for c in ranks.values())
    flat = bootstrap.bootstrap_weights(rows, "case", 4, 6, hash_fn).collect()
    assert len(flat) == len(wanted) and {(r["replicate"], r["case"]): r["weight"] for r in flat} == wanted
    for r in bootstrap.bootstrap_vectors(rows, "case", 4, 6, hash_fn).collect():
        assert r["weights"] == [wanted[b, r["case"]] for b in range(5)]


def test_md5_numbers_are_those_of_the_column(spark):
    """Draws in numpy, over changes of digits and pieces, are `md5_hash`'s."""
    want = [r[0] for r in spark.range(8185, 10_005, numPartitions=1).select(hashing.md5_hash(-3, 17, F.col("id"))).collect()]
    assert hashing.md5_numbers("-3:17:", 8185, 10_005).tolist() == want
    spread = hashing.md5_numbers("1:2:", 0, 20_000)
    assert len(spread) == 20_000 and hashing.md5_numbers("1:2:", 8190, 8195).tolist() == spread[8190:8195].tolist()
    assert hashing.md5_numbers("1:2:", 4, 4).size == 0
    with pytest.raises(ValueError, match="one block"):
        hashing.md5_numbers("x" * 55, 0, 10)


def test_many_keys_are_weighed_in_tiles_and_slices(spark, monkeypatch):
    """Partial sums of many keys meet in one task per tile and slice; before, every task sent every key it saw."""
    rows = spark.createDataFrame([(f"c{i % 13}", i % 40 if i % 40 else None, float(i % 7)) for i in range(400)] + [(None, 1, 1.0)], "case string, key int, v double")
    vectors_, flat = bootstrap.bootstrap_vectors(rows, "case", 25, 3), bootstrap.bootstrap_weights(rows, "case", 25, 3)
    sums = {"s": F.col("v"), "n": F.lit(1)}
    order = lambda df: sorted(map(tuple, df.select("replicate", "key", "s", "n").collect()), key=repr)
    wanted = order(bootstrap.weigh(rows, flat, "case", ["key"], sums))
    monkeypatch.setattr(bootstrap, "MANY_KEYS", 3)
    monkeypatch.setattr(bootstrap, "SLICE", 8)
    monkeypatch.setattr(bootstrap, "N_BOOTSTRAP", 25)
    for held in (640, 16_000_000):
        monkeypatch.setattr(bootstrap, "HELD", held)
        done = bootstrap.weigh(rows, vectors_, "case", ["key"], sums)
        assert order(done) == wanted
    assert "_tile" in done._jdf.queryExecution().optimizedPlan().toString()


def test_weights_as_arrays_weigh_like_rows(spark):
    rows = spark.createDataFrame([(f"c{i % 9}", i % 4 if i % 11 else None, float(i) if i % 5 else None, i) for i in range(60)], "case string, grp int, v double, n int")
    flat = bootstrap.bootstrap_weights(rows, "case", 25, 3)
    vectors_ = bootstrap.bootstrap_vectors(rows, "case", 25, 3)
    listed = vectors_.select("case", F.posexplode("weights").alias("replicate", "weight")).filter("weight > 0")
    plain = lambda df: sorted(map(tuple, df.select("replicate", "case", F.col("weight").cast("long")).collect()))
    assert plain(flat) == plain(listed)
    for keys in ([], ["grp"], ["grp", "case"]):
        sums = {"s": F.col("v"), "n": F.col("n")} if "case" not in keys else {"s": F.col("v"), "n": F.lit(1)}
        keys = [k for k in keys if k != "case"]
        order = lambda df: sorted(map(tuple, df.select("replicate", *keys, F.round(F.coalesce("s", F.lit(0.0)), 9), F.col("n").cast("long")).collect()), key=repr)
        assert order(bootstrap.weigh(rows, vectors_, "case", keys, sums)) == order(bootstrap.weigh(rows, flat, "case", keys, sums))


def test_spectrum(spark):
    x = np.random.default_rng(2).normal(size=(30, 5))
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    share = s / s.sum()
    row = linear.spectrum(vectors(spark, x), "x").first()
    assert row["effective_rank"] == pytest.approx(np.exp(-(share * np.log(share)).sum()))
    assert row["top_eigenvalue_share"] == pytest.approx(share.max())


def test_linear_probe_separates_classes(spark):
    rng = np.random.default_rng(3)
    y = ["a" if i % 2 else "b" for i in range(80)]
    x = rng.normal(size=(80, 3)) + np.array([[2.0, 0, 0] if v == "a" else [-2.0, 0, 0] for v in y])
    df = vectors(spark, x, label=y)
    model = linear.fit_linear_probe(df, "x", "label", 50)
    out = linear.predict_linear_probe(model, df, "x")
    assert out.filter("pred = label").count() >= 75


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    # A third of the references are copies of one vector, one is zero, and group 2 has two references.
    ref = np.vstack([rng.normal(size=(60, 5)), np.tile(rng.normal(size=5), (30, 1)), np.zeros((1, 5))])
    ref_group = np.array([0] * 50 + [1] * 39 + [2] * 2)
    query = np.vstack([rng.normal(size=(12, 5)), np.zeros((1, 5))])
    query_group = np.array([0] * 6 + [1] * 5 + [2] * 2)
    r = vectors(spark, ref, grp=ref_group.tolist()).select("grp", F.col("id").alias("rid"), F.col("x").alias("vec"))
    q = vectors(spark, query, grp=query_group.tolist()).select("grp", F.col("id").alias("qid"), F.col("x").alias("vec"))

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    for k, block in ((1, 8), (5, 7), (40, 1024)):
        out = neighbours.cosine_neighbours(q, r, k, block=block).toPandas()
        for i in range(len(query)):
            at = np.flatnonzero(ref_group == query_group[i])
            sim = np.round(unit(query[i : i + 1])[0] @ unit(ref[at]).T, 12)
            want = [at[j] for j in np.lexsort((at, -sim))[:k]]
            got = out[out["qid"] == i].sort_values("rank")
            assert len(got) == len(want)
            np.testing.assert_allclose(got["similarity"], sorted(sim, reverse=True)[:k], atol=1e-9)
            if k == 40:
                continue
            clear = [w for w in want if (np.abs(sim - sim[list(at).index(w)]) < 1e-9).sum() == 1]
            assert set(clear) <= set(got["rid"])


def test_precision_by_hand(spark):
    ref = vectors(spark, [[1, 0], [1, 0.1], [0, 1], [0.1, 1]])
    q = vectors(spark, [[1, 0.05]])
    near = neighbours.cosine_neighbours(
        q.select(F.lit(0).alias("grp"), (F.col("id") + 10).alias("qid"), F.col("x").alias("vec")),
        ref.select(F.lit(0).alias("grp"), F.col("id").alias("rid"), F.col("x").alias("vec")), 4,
    )
    labels = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b"), (10, "a")], "id bigint, label string")
    row = neighbours.neighbour_precision(near, labels, (1, 2, 4)).first()
    assert [row[f"precision_at_{k}"] for k in (1, 2, 4)] == [1.0, 1.0, 0.5]


def test_silhouettes_match_pairs(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(20, 3)), [i % 3 for i in range(19)] + [9]
    x[4] = 0
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    out = {r["id"]: r["silhouette"] for r in neighbours.silhouettes(vectors(spark, x, label=y), "id", "x", "label").collect()}
    y = np.array(y)
    for i in range(20):
        own = y == y[i]
        if own.sum() == 1:
            assert out[i] == 0
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][y == c].mean() for c in set(y.tolist()) - {y[i]})
        assert out[i] == pytest.approx((b - a) / max(a, b))


def test_mmd_is_zero_on_equal_samples_and_blocks_do_not_matter(spark):
    x = np.random.default_rng(6).normal(size=(30, 4)) * 3
    both = vectors(spark, np.vstack([x, x]), side=[False] * 30 + [True] * 30, b=[0] * 60)
    assert neighbours.mmd(both, F.col("side"), "x", "b", "id").first()["mmd"] == pytest.approx(0, abs=1e-12)
    half = vectors(spark, x, side=[i < 11 for i in range(30)], b=[0] * 30)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 16)
    want = k[:11, :11].mean() + k[11:, 11:].mean() - 2 * k[:11, 11:].mean()
    for block in (4, 1024):
        assert neighbours.mmd(half, F.col("side"), "x", "b", "id", block).first()["mmd"] == pytest.approx(want)


# ---- bootstrap and metrics


def test_every_replicate_draws_as_many_cases_as_there_are(spark):
    cases = spark.createDataFrame([(f"c{i}",) for i in range(37)], "case string")
    w = bootstrap.bootstrap_weights(cases, "case", 12, 4).toPandas()
    assert (w.groupby("replicate")["weight"].sum() == 37).all() and w["replicate"].nunique() == 13
    again = bootstrap.bootstrap_weights(cases.repartition(5), "case", 12, 4).toPandas()
    order = ["replicate", "case"]
    assert w.sort_values(order).values.tolist() == again.sort_values(order).values.tolist()


def test_integer_weights_equal_duplicated_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, str(rng.integers(3)), str(rng.integers(4)), int(rng.integers(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, true string, pred string, w int")
    twice = df.filter("w > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w"))))
    a = metrics.classification_scores(metrics.confusion(df.filter("w > 0"), "true", "pred", weight=F.col("w"))).first()
    b = metrics.classification_scores(metrics.confusion(twice, "true", "pred")).first()
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y)
    c = metrics.clustering_agreement(metrics.confusion(df.filter("w > 0"), "true", "pred", weight=F.col("w"))).first()
    d = metrics.clustering_agreement(metrics.confusion(twice, "true", "pred")).first()
    assert c["ari"] == pytest.approx(d["ari"]) and c["nmi"] == pytest.approx(d["nmi"])


def test_identical_clusters_agree_fully(spark):
    df = spark.createDataFrame([(i % 4, (i % 4) + 10) for i in range(40)], "a int, b int")
    row = metrics.clustering_agreement(metrics.confusion(df, "a", "b")).first()
    assert row["ari"] == pytest.approx(1) and row["nmi"] == pytest.approx(1)


def test_constant_rows_have_no_correlation(spark):
    df = spark.createDataFrame([(0, 0.1, 1.0), (0, 0.1, 2.0), (0, 0.1, 5.0), (1, 1.0, 2.0), (1, 2.0, 4.0)], "s int, true double, pred double")
    out = {r["s"]: r["r"] for r in metrics.sample_pearson(df, "s").collect()}
    assert out[0] is None and out[1] == pytest.approx(1)


def test_paired_differences_skip_other_counts_and_doubles(spark):
    rows = [("a", "cv", "t1", 5, 0.8, [0.7, 0.9]), ("b", "cv", "t1", 5, 0.6, [0.6, 0.5]), ("a", "cv", "t2", 5, 0.8, [0.7, 0.9]),
            ("b", "cv", "t2", 6, 0.6, [0.6, 0.5]), ("a", "cv", "t3", 5, 0.8, [0.7, 0.9]), ("b", "cv", "t3", 5, 0.6, [0.6, 0.5]),
            ("b", "cv", "t3", 5, 0.1, [0.6, 0.5])]
    df = spark.createDataFrame(rows, "embeddings string, split string, task string, n int, acc double, acc_boot array<double>")
    (row,) = bootstrap.paired_differences(df, "a", "b", ["split", "task"], ["n"], ["acc"]).collect()
    assert row["task"] == "t1" and row["delta"] == pytest.approx(0.2) and row["share_above"] == 1.0
    assert row["delta_lo"] == pytest.approx(0.1 + 0.025 * 0.3)


# ---- survival


def brute_concordance(time, event, risk, strata):
    good = pairs = 0.0
    for i, j in itertools.permutations(range(len(time)), 2):
        if strata[i] == strata[j] and event[i] and time[i] < time[j]:
            pairs += 1
            good += 1.0 if risk[i] > risk[j] else 0.5 if risk[i] == risk[j] else 0.0
    return good, pairs


def patients(spark, n=70, seed=8, d=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    time = np.floor(rng.exponential(12, n))
    event = rng.random(n) < 0.6
    strata = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 3, n))
    risk = np.round(x[:, 0], 1)
    rows = [(i, x[i].tolist(), float(time[i]), bool(event[i]), float(risk[i]), int(strata[i])) for i in range(n)]
    return (x, time, event, risk, strata), spark.createDataFrame(rows, "i int, x array<double>, time double, event boolean, risk double, s int")


def test_concordance_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1, 3.0), (2.0, 0, 5.0), (3.0, 1, 1.0), (3.0, 1, 3.0)], "time double, event int, risk double")
    row = survival.concordance(df).first()
    assert row["c_index"] == 0.5 and row["pairs"] == 3
    none = survival.concordance(df.withColumn("event", F.lit(0))).first()
    assert none["c_index"] is None and none["pairs"] == 0


def test_concordance_matches_all_pairs(spark):
    (_, time, event, risk, strata), df = patients(spark)
    good, pairs = brute_concordance(time, event, risk, strata)
    row = survival.concordance(df, ["s"]).first()
    assert row["pairs"] == pairs and row["c_index"] == pytest.approx(good / pairs)


def test_pair_weights_equal_duplicated_patients(spark):
    (_, time, event, risk, strata), df = patients(spark, 40, 9)
    w = np.random.default_rng(9).integers(0, 4, 40)
    weighted = df.join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(w)], "i int, w int"), "i")
    row = survival.concordance_sums(weighted, ["s"], weight="w").agg(F.sum("concordant").alias("c"), F.sum("pairs").alias("p")).first()
    at = np.repeat(np.arange(40), w)
    good, pairs = brute_concordance(time[at], event[at], risk[at], strata[at])
    assert row["p"] == pytest.approx(pairs) and row["c"] == pytest.approx(good)


def brute_cox(x, time, event, strata, alpha, beta):
    eta, loss = x @ beta, 0.0
    for i in np.flatnonzero(event):
        at = (strata == strata[i]) & (time >= time[i])
        loss -= eta[i] - np.log(np.exp(eta[at]).sum())
    return loss / len(x) + 0.5 * alpha * beta @ beta


def test_cox_loss_and_gradient(spark):
    (x, time, event, _, strata), df = patients(spark)
    beta = np.array([0.4, -0.3, 0.2])
    loss, grad = survival.cox_objective(df, "x", ["s"], beta, 0.05)
    assert loss == pytest.approx(brute_cox(x, time, event, strata, 0.05, beta))
    for j in range(3):
        step = np.eye(3)[j] * 1e-5
        slope = (brute_cox(x, time, event, strata, 0.05, beta + step) - brute_cox(x, time, event, strata, 0.05, beta - step)) / 2e-5
        assert grad[j] == pytest.approx(slope, abs=1e-7)


def test_cox_over_many_ranges_and_heavy_ties(spark, monkeypatch):
    monkeypatch.setattr(survival, "RANGE_ROWS", 5)
    rng = np.random.default_rng(31)
    n = 300
    x = rng.normal(size=(n, 3)) * [1, 2, 20]
    time = np.where(rng.random(n) < 0.3, 7.0, rng.integers(0, 40, n)).astype(float)  # a third share one time
    event, strata = rng.random(n) < 0.5, rng.choice(["a", "b|c", None], n, p=[0.7, 0.2, 0.1])
    rows = [([float(v) for v in x[i]], float(time[i]), bool(event[i]), strata[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "x array<double>, time double, event boolean, s string")
    job = survival.CoxJob(df.withColumn("m", F.lit(3)), "x", "m", ["s"])
    assert len(job.model) > 20 and job.blocks.filter("_alone = 1").count() > 0
    strata, beta = np.array([s or "none" for s in strata]), np.array([0.4, -0.3, 0.9])
    loss, grad = job.evaluate({3: beta}, {3: 0.05})[3]
    assert loss == pytest.approx(brute_cox(x, time, event, strata, 0.05, beta), rel=1e-9)
    for j in range(3):
        step = np.eye(3)[j] * 1e-5
        slope = (brute_cox(x, time, event, strata, 0.05, beta + step) - brute_cox(x, time, event, strata, 0.05, beta - step)) / 2e-5
        assert grad[j] == pytest.approx(slope, abs=1e-6)


def test_lbfgs_reaches_the_minimum():
    a = np.diag([1.0, 30.0, 500.0])
    run = survival.lbfgs(np.array([3.0, -2.0, 1.0]), 200, 1e-8)
    point = next(run)
    while True:
        try:
            point = run.send((0.5 * point @ a @ point - point.sum(), a @ point - 1))
        except StopIteration as stop:
            np.testing.assert_allclose(stop.value, 1 / np.diag(a), atol=1e-4)
            break


def test_cox_models_fit_together(spark):
    (x, time, event, _, strata), df = patients(spark, 50, 10, 2)
    both = df.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).filter("m = 0 OR i < 35")
    fits = survival.fit_models(survival.CoxJob(both, "x", "m", ["s"]), {0: 0.5, 1: 0.5}, max_iter=8)
    for m, keep in ((0, np.arange(50) >= 0), (1, np.arange(50) < 35)):
        args = (x[keep], time[keep], event[keep], strata[keep], 0.5)
        best = brute_cox(*args, fits[m])
        for step in itertools.product((-0.02, 0.02), repeat=2):
            assert brute_cox(*args, fits[m] + np.array(step)) > best


# ---- factorisation


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(11)
    c, z = (rng.random((40, 8)) < 0.3).astype(float), np.abs(rng.normal(size=40))
    ctz, gram, l3 = c.T @ z, c.T @ c, 3.0
    u = factorize.nonnegative_lasso(ctz[:, None], gram, l3, np.zeros((8, 1)))[:, 0]
    slope = -2 * (ctz - gram @ u) + l3
    assert (u >= 0).all() and (u > 0).any()
    np.testing.assert_allclose(slope[u > 0], 0, atol=1e-5)
    assert (slope[u == 0] >= -1e-6).all()
    assert not factorize.nonnegative_lasso(ctz[:, None], gram, float(factorize.lambda_max(ctz[:, None])[0]), np.zeros((8, 1))).any()


def factor_data(spark, seed=12):
    rng = np.random.default_rng(seed)
    z = np.abs(rng.normal(size=(24, 2))) * np.array([[1, 0]] * 12 + [[0, 1]] * 12)
    y = z @ rng.normal(size=(2, 60)) + 0.1 * rng.normal(size=(24, 60))
    y = (y - y.mean(1, keepdims=True)) / y.std(1, ddof=1, keepdims=True)
    names = [f"g{i:02d}" for i in range(24)]
    edges = [("first", n) for n in names[:12]] + [("second", n) for n in names[12:]] + [("mixed", n) for n in names[::3]]
    return y, names, vectors(spark, y.T), spark.createDataFrame(edges, "set string, feature string")


def test_factorisation_descends_and_finds_its_sets(spark):
    y, names, rows, edges = factor_data(spark)
    model = factorize.fit(rows, "x", names, edges, k=2, l3=1.0, max_iter=25)
    assert (model.z >= 0).all() and (model.u >= 0).all()
    top = {model.sets[i] for i in model.u.argmax(axis=0)}
    assert top == {"first", "second"}
    # The objective of the last step agrees with its definition.
    b = factorize.b_map(model.z, model.l2) @ y
    c = np.array([[n in {r["feature"] for r in edges.filter(F.col("set") == s).collect()} for s in model.sets] for n in names], float)
    want = ((y - model.z @ b) ** 2).sum() + model.l1 * ((model.z - c @ model.u) ** 2).sum() + model.l2 * (b**2).sum() + 1.0 * model.u.sum()
    assert model.objectives[-1] == pytest.approx(want, rel=1e-6)
    pairs = linear.stack(model.project(rows, "x").orderBy("id").toPandas()["embedding"])
    np.testing.assert_allclose(pairs, b.T, atol=1e-8)


def test_component_rules():
    assert factorize.elbow(np.array([10.0, 9.0, 1.0, 0.5, 0.2, 0.0])) == 2
    rng = np.random.default_rng(13)
    y = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 200)) * 3 + rng.normal(size=(60, 200))
    assert factorize.noise_rank(np.linalg.svd(y, compute_uv=False), 60, 200) == 3


def test_svd_signs_and_values(spark):
    y, _, rows, _ = factor_data(spark)
    u, d = factorize.top_svd(rows, "x", 3)
    np.testing.assert_allclose(d, np.linalg.svd(y, compute_uv=False)[:3])
    assert ((np.maximum(u, 0) ** 2).sum(0) >= (np.minimum(u, 0) ** 2).sum(0)).all()


def test_held_out_auc_counts_pairs(spark):
    rng = np.random.default_rng(14)
    z = np.round(rng.random(30), 1)
    held = [i < 5 for i in range(12)]
    zt = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(z)], "feature int, lv int, z double")
    edges = spark.createDataFrame([("s", i, held[i]) for i in range(12)], "set string, feature int, held boolean")
    row = factorize.held_out_auc(zt, edges, spark.createDataFrame([("s", 0)], "set string, lv int"), 30, [0.3, 0.6]).first()
    a, b = z[:5], z[12:]
    want = ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean()
    assert row["auc"] == pytest.approx(want)


def test_false_discovery_keeps_untested_rows(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None), (4, 0.5), (5, 0.03)], "i int, p double")
    out = {r["i"]: r["fdr"] for r in factorize.benjamini_hochberg(df, "p").collect()}
    assert out[3] is None
    for i, want in {0: 0.05, 2: 0.05, 5: 0.05, 1: 0.05, 4: 0.5}.items():
        assert out[i] == pytest.approx(want)


def test_fold_fit_saves_loads_and_embeds(spark, tmp_path):
    rng = np.random.default_rng(15)
    m = rng.poisson(1.5, (50, 10))
    m[:, 9] = 2
    values = spark.createDataFrame([(s, f, float(v)) for s, r in enumerate(m) for f, v in enumerate(r) if v], "sample int, feature bigint, value double")
    samples = spark.createDataFrame([(s, "train" if s < 35 else "test") for s in range(50)], "sample int, split string")
    edges = spark.createDataFrame([("a", f) for f in range(6)] + [("b", f) for f in range(4, 9)], "set string, feature bigint")
    model, scaler, features, notes = factorize.fit_fold(values, samples, "sample", edges, min_genes=3, k=2, max_iter=5)
    assert model.features == list(range(9))  # the constant feature is dropped
    factorize.save(model, scaler, notes, str(tmp_path / "fold0"))
    again, kept = factorize.load(spark, str(tmp_path / "fold0"))
    np.testing.assert_allclose(again.z, model.z)
    out = factorize.embed(again, kept, values, samples, "sample")
    assert out.count() == 50
    x = m[:35, :9].astype(float)
    scaled = (np.clip(m[:, :9], x.min(0), x.max(0)) - x.mean(0)) / x.std(0, ddof=1)
    want = scaled @ factorize.b_map(model.z, model.l2).T
    np.testing.assert_allclose(linear.stack(out.orderBy("sample").toPandas()["embedding"]), want, atol=1e-9)
    with pytest.raises(ValueError, match="missing from the data"):
        factorize.embed(again, kept, values.filter("feature <> 0"), samples, "sample")


# ---- leakage


def test_scramble_catches_a_leak(spark):
    rng = np.random.default_rng(16)
    rows = [(i, rng.normal(size=4).tolist(), "train" if i < 20 else "val" if i < 25 else "test") for i in range(30)]
    df = spark.createDataFrame(rows, "sample_index int, values array<double>, split string")

    def honest(d):
        return linear.pca_embeddings(d.withColumn("t", F.col("split") == "train"), "values", "t", 2)

    def leaky(d):
        return linear.pca_embeddings(d.withColumn("t", F.lit(True)), "values", "t", 2)

    checks.assert_ignores_held_out(honest, df)
    with pytest.raises(AssertionError, match="held-out rows"):
        checks.assert_ignores_held_out(leaky, df)


def test_shared_pca_pass_equals_fold_by_fold(spark):
    from tidyfold.operators import splits
    from tidyfold.plans.baseline import pca_every_fold

    x = np.random.default_rng(17).normal(size=(60, 5)) * [8, 4, 2, 1, 0.5] + 3
    rows = vectors(spark, x, bucket=[(i * 7) % 100 for i in range(60)])
    out = pca_every_fold(rows, "x", 2)
    assert out.count() == 300
    for fold in (0, 3):
        train = splits.split_of(F.col("bucket"), fold) == "train"
        want = linear.pca_embeddings(rows.withColumn("t", train), "x", "t", 2).orderBy("id").toPandas()["embedding"]
        got = out.filter(F.col("fold") == fold).orderBy("id").toPandas()["embedding"]
        np.testing.assert_allclose(linear.stack(got), linear.stack(want), atol=1e-8)


def test_rank_test_is_exact_for_small_untied_samples():
    from tidyfold.operators.factorize import _arrangements

    for few, many in ((1, 4), (3, 5), (4, 6)):
        places = list(itertools.combinations(range(few + many), few))
        above = [sum(p - i for i, p in enumerate(place)) for place in places]  # pairs in which the inner one is larger
        for u in range(few * many + 1):
            assert _arrangements(few, many)[few * many - u] == pytest.approx(sum(a >= u for a in above) / len(above))


def test_rank_test_falls_back_to_the_normal_score(spark):
    from tidyfold.operators.factorize import rank_test

    rows = [(1.0, 15.0, 3, 5, False), (1.0, 15.0, 3, 5, True), (1.0, 50.0, 9, 9, False), (None, None, 0, 5, False)]
    table = spark.createDataFrame(rows, "score double, above double, inner bigint, outer bigint, tied boolean")
    got = [r[0] for r in table.select(rank_test("score", "above", "inner", "outer", "tied")).collect()]
    normal = 0.5 * math.erfc(1 / math.sqrt(2))
    assert got[0] == pytest.approx(1 / 56) and got[1] == got[2] == pytest.approx(normal) and got[3] is None


def test_supervision_by_organ_project_or_none(spark):
    from tidyfold.operators import selection

    samples = spark.createDataFrame([("TCGA-LUAD",), ("TCGA-LUSC",), ("TCGA-UVM",)], "project string")
    organ = {r["project"]: (r["name"], r["class_index"]) for r in selection.supervision_labels(samples, "project", "organ").collect()}
    assert organ["TCGA-LUAD"] == organ["TCGA-LUSC"] and organ["TCGA-UVM"][0] == "eye"
    assert selection.label_classes(selection.supervision_table(spark, "organ"), "name").count() == 26
    assert selection.label_classes(selection.supervision_table(spark, "project"), "name").count() == 33
    assert selection.supervision_table(spark, "none").count() == 0
    for bad in ("none", "tissue"):
        with pytest.raises(ValueError):
            selection.supervision_labels(samples, "project", bad)


def test_dense_rows_and_affine_maps_are_made_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(linear, "CUT_CELLS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    assert [p.num_rows for p in linear.cut([batch], 3)] == [3, 3, 3, 1] and [p.num_rows for p in linear.cut([batch.slice(0, 2)], 99)] == [1, 1]
    values = spark.createDataFrame([(s, f, float(s + 10 * f)) for s in range(1, 20) for f in (0, 2)] + [(1, 1, None)], "sample int, feature int, value double")
    features = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "index int, feature int")
    samples = spark.range(21).select(F.col("id").cast("int").alias("sample"))
    rows = factorize.to_arrays(values, features, samples, "sample")
    found = {r["sample"]: r["y"] for r in rows.collect()}
    assert found == {s: [float(s), None if s == 1 else 0.0, float(s + 20)] if 0 < s < 20 else [0.0] * 3 for s in range(21)}
    mapped = linear.affine(rows.filter("sample <> 1"), "y", np.ones(3), np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 2.0]]), "z").collect()
    assert len(mapped) == 20 and all(r["z"] == [r["y"][0] - 1, 2 * (r["y"][2] - 1)] for r in mapped)
